"""Spark-native analytics for marked point processes."""
