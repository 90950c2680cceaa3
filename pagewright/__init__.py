"""Passage retrieval over document corpora, on Spark."""
