"""Spark-native variant analytics."""
