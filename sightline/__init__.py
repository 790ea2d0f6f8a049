"""Spark-native analytics over noisy, repeatedly observed participation data."""
