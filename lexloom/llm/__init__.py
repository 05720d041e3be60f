"""Operators for preparing text collections: repeats, quality, scores, tokens, search."""
