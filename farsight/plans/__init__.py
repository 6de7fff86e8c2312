"""Choosing a strategy: costs, recommendation and what Spark's own plan says."""
