"""Relational building blocks: DataFrames in, DataFrames out."""
