"""Parallel-text analytics as Spark DataFrames: encode, align, score."""
