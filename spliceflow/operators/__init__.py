"""Operators from DataFrames to DataFrames, keyed by track."""
