"""Relational operators: DataFrames in, DataFrames out; plans are left to Catalyst."""
