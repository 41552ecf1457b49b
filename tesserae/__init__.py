"""Spark-native analytics for block-structured numeric signals."""
