"""Operators for training-data pipelines: tokens, duplicates, quality, toxicity, archives and vector search."""
