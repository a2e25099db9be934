"""Sinks for small results: tables, pictures and reports."""
