"""Spark-native analytics over street-network data."""
