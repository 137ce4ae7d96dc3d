"""Spark-native document-layout analytics: streaming."""
