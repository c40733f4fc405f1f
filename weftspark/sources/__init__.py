"""Where source files, histories and configurations come from."""
