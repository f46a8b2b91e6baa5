"""Spark-native analytics for tick, bar, curve and positioning tables."""
