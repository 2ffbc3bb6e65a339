"""Operators for large training corpora: deduplication, token counts, packing, search, scans and quality."""
