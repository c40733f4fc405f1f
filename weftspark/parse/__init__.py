"""Declarations, calls and imports of JavaScript and TypeScript files, found by Spark over token rows."""
