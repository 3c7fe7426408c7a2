"""Operators over alignment tables: DataFrames in, DataFrames out, no actions."""
