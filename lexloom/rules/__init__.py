"""Lookup tables, word lists, patterns and constants."""
