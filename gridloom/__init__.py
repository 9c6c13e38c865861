"""Chunked N-dimensional arrays as Spark DataFrames."""
