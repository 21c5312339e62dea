"""Spark-native document retrieval and text-corpus engine."""

__version__ = "0.1.0"
