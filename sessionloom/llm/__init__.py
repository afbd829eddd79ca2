"""Operators of a training-data pipeline: filters, deduplication, scoring, mixing, search and tokens over text tables."""
