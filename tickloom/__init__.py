"""Spark-native analytics for market time series; see README.md."""
