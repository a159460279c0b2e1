"""Analyses of a corpus, each a function from DataFrames to a DataFrame."""
