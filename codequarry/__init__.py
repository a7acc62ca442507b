"""Spark-native code analytics: see README.md."""
