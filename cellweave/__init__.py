"""Similarity and partial-copy analytics on PySpark."""

__version__ = "0.1.0"
