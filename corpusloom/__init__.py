"""Spark-first retrieval and training-data engine for code and text corpora."""

__version__ = "0.1.0"
