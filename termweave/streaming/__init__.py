"""Incremental upkeep of the concept index."""
