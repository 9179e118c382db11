"""Spark-native analytics over marketplace sales uploads."""
