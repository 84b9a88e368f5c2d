"""Operators for training-data pipelines: deduplication, joins, scans, rules, mixing, packing and media columns."""
