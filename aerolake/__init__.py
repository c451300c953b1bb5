"""Spark-native analytics over entity-keyed hourly and daily time series."""
