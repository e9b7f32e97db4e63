"""Spark-native analytics for source-code security findings and text corpora."""
