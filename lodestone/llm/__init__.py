"""Operators that prepare training corpora: search, deduplication, packing, quality, archives, tokens, mixing, extraction."""
