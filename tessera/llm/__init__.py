"""Operators for large text corpora: language, quality, privacy, mixing, dedup, archives, media, tokens."""
