"""Spark-native private clustering analytics."""
