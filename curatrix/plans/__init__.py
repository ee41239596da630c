"""Queries over the test tables, one for each operator, and the same in SQL."""
