"""Operators of a training-data pipeline: deduplication, packing, scanning, encoding, archives, classification."""
