"""Curation and evaluation analytics on Spark DataFrames."""
