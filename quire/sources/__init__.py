"""Spark-native document-layout analytics: sources."""
