"""Retrieval over a stream of arriving queries."""
