"""Operators for training-data preparation over texts and sequences."""
