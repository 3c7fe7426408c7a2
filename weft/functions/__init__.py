"""Scalar functions, as expressions over columns."""
