"""Operators for preparing training text: tokens, quality, deduplication, packing and more."""
