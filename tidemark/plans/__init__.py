"""Queries that a user runs, over tables derived from the given ones."""
