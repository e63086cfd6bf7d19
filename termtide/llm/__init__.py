"""Operators of a training-data pipeline: tokens, deduplication, search, formatting, packing."""
