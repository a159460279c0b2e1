"""Operators for preparing training text: packing, deduplication, scoring, search and mixing."""
