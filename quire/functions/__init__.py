"""Spark-native document-layout analytics: functions."""
