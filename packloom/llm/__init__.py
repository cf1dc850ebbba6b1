"""Operators of a training-data pipeline: deduplication, extraction, scoring, mixing, packing, search."""
