"""Corpus analytics and hybrid retrieval on Spark: DataFrames in, DataFrames out."""
