"""Operators for training-data pipelines: packing, archives, extraction, dedup, mixing, formatting."""
