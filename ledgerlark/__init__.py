"""Retail customer analytics on Spark DataFrames."""
