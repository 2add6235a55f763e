"""Operators for large training-data corpora: dedup, mixing, joins, scoring, packing, scans."""
