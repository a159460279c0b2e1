"""Column expressions and per-document projections."""
