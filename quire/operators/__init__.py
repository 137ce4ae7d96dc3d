"""Spark-native document-layout analytics: operators."""
