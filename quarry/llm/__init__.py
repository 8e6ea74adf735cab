"""Operators for preparing training text: counting, filtering, deduplication, extraction, packing."""
