"""Ordered, n-dimensional array analytics on Spark DataFrames."""
