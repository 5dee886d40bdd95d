"""Whole jobs, and the queries that exercise every operator on the given tables."""
