"""Spark-native analytics for customer verbatims: import, cleaning, deduplication, sampling, topics, counts."""

__version__ = "0.1.0"
