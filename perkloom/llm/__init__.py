"""Operators for preparing text corpora: fingerprints, dedup, tokens, personal data, scores, mixing."""
