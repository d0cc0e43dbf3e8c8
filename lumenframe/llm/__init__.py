"""Operators for text and training-data pipelines."""
