"""Hybrid retrieval and entity-graph analytics over document corpora, on Spark."""
