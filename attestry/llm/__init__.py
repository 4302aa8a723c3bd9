"""Operators of a training-data pipeline: mixing, language, duplicates, extraction, quality, search and packing."""
