"""Operators for preparing training data: language, duplicates, contamination, private data, tokens."""
