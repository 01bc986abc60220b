"""Operators for training-data pipelines over document corpora."""
