"""Operators of a training-data pipeline: archives, deduplication, personal data, tokens, packing, scoring."""
