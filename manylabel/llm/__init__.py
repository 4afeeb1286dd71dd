"""Operators for training-data corpora: search, deduplication, scoring, packing, encoding."""
