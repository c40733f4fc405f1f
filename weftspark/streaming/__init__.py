"""Graphs kept up to date by streams of changed files and events."""
