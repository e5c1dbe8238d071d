"""Operators of a training-data pipeline: filters, classifiers, near duplicates, tokens and archives."""
