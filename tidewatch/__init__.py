"""Spark-native analytics over daily market series."""
