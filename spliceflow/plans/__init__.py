"""Registered queries over the given tables, by family, each with the SQL that states the same result."""
