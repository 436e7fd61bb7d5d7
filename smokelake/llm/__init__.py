"""Operators for training-data pipelines: counting, mixing, scoring, search, joins, dedup, encoding, rules and scans."""
