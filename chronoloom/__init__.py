"""Spark-native analytics for execution traces of embedded devices."""
