"""Operators for large text corpora: deduplication, filtering, scoring, search and packing."""
