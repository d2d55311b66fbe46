"""Operators for preparing training text: extraction, deduplication, scoring, packing, archives."""
