"""Spark-native analytics for battery-cycler time series."""
