"""Spark-native document retrieval analytics."""
