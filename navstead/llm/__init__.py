"""Operators for training-data pipelines: packing, search, deduplication, tokens, chat, filters."""
