"""Spark-native analytics over listings gathered from many sources."""
