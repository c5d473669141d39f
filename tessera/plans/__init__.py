"""Compositions of operators: whole tools and the query catalogue."""
