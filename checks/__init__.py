"""Comparison of the registered queries with their SQL twins."""
