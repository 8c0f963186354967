"""Operators for large text corpora: conversations, pages, duplicates, packing, leakage, quality."""
