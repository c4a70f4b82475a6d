"""Operators that prepare training text: mixing, deduplication, packing, filters, search."""
