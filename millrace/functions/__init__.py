"""Scalar functions; each returns a column expression."""
