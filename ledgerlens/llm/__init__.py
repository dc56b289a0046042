"""Operators for training data: quality, formats, mixing, tokens, fingerprints, joins, secrets, language models."""
