"""Sparse linear systems and run reports as Spark DataFrames."""
