"""Operators: each takes DataFrames and returns a DataFrame; nothing here runs a job itself
except where a docstring says so."""
