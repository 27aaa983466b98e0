"""Spark-native analytics for work items and the dependency graph between them."""
