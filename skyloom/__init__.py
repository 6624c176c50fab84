"""Spark-native analytics over recorded web observations."""
