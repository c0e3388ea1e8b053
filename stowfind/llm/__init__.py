"""Operators that prepare training text: packing, deduplication, scans, filters, scores and token counts."""
