"""Operators on DataFrames: key alignment, summaries, key spines, lookups, exploration."""
