"""Spark-native engine that turns text corpora into audited question sets."""

__version__ = "0.1.0"
