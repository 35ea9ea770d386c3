"""Operators for training-data pipelines: search, language models, deduplication, tokens and personal data."""
