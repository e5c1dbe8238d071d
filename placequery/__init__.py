"""Segment-retrieval analytics on Spark DataFrames."""
