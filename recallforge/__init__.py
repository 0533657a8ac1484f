"""Spark-native memory recall and vector search engine."""
