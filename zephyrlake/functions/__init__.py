"""Column expressions: indices, geometry, meteorology and time."""
