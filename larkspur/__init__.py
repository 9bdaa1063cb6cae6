"""Larkspur: Spark-first retrieval analytics and corpus data processing."""
