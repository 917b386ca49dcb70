"""Operators for building training corpora: search, dedup, filters, mixing, packing, token files."""
