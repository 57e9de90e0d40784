"""Spark-native scoring of text-response quality."""
