"""Catalogue building and guess-log analytics on Spark DataFrames."""
