"""Operators: each takes DataFrames and returns DataFrames, and collects nothing that grows."""
