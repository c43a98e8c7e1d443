"""Operators for text corpora: encodings, personal data, tokens, mixes and pieces."""
