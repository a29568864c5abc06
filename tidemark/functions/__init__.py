"""Spark-native activity-log operators."""
