"""Ladder analytics as Spark jobs: every function takes DataFrames and plain parameters and returns a DataFrame."""
