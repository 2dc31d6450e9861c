"""Column expressions: vectors and numeric scales."""
