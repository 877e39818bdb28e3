"""Operators for large text corpora: packing, filtering, deduplication, search and tokenisation."""
