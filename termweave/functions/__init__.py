"""Column expressions; no Python runs for a row."""
