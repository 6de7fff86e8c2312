"""Filtered vector search, strategy advice and training-data operators on Apache Spark."""

__version__ = "0.1.0"
