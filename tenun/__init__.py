"""Spark-native text-quality and training-data engine."""
