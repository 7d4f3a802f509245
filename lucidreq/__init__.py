"""Spark-native analytics for requirement catalogs."""
