"""Operators for preparing training text: deduplication, scoring, filtering, packing, tokens and vector search."""
