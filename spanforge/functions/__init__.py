"""Scalar functions as Columns, with their twins in Python."""
