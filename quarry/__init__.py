"""Quarry: a Spark-native retrieval-analytics engine."""
