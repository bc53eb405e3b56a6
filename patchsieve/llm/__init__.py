"""Operators and queries for training-data corpora."""
