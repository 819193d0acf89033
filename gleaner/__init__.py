"""Spark-native retrieval, cleaning and measurement of text-and-vector collections."""
