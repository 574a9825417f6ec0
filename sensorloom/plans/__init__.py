"""Whole jobs, and the queries that show each operator on the test tables."""
