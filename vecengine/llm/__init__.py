"""Operators for preparing text corpora: filtering, deduplication, tokenising, packing, scoring."""
