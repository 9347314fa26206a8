"""Spark-native text-style analytics and training-data operators."""
