"""Readers of source files and of the test tables."""
