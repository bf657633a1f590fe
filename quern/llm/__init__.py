"""Operators for large training-data collections. Nothing outside this package imports it."""
