"""Scalar functions over structured names, as Column expressions."""
