"""Spark-native document-layout text extraction and evaluation."""
