"""Tessera: content-graph and retrieval analytics on Spark."""
