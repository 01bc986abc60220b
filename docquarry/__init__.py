"""Spark-native search and analysis of structured API documentation."""

__version__ = "0.1.0"
