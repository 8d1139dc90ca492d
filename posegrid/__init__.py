"""Spark-native multi-view motion analytics."""
