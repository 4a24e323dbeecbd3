"""Operators: DataFrames in, DataFrames out, keyed by recording."""
