"""Spark-native analytics for process-safety barrier data."""
