"""Operators over catalogue tables: each takes DataFrames and returns a DataFrame."""
