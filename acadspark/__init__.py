"""Spark-native analytics over crawled academic web data."""
