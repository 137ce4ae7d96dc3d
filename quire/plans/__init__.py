"""Spark-native document-layout analytics: plans."""
