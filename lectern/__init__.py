"""Corpus building, search and reading on Spark DataFrames."""
