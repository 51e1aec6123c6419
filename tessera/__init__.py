"""Spark-native analytics for text, graph and event data."""
