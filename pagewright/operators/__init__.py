"""Joins, aggregations, windows, rankings and set operations over the passage tables."""
