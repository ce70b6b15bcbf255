"""Operators for training-data corpora: scoring, deduplication, mixing and token output."""
