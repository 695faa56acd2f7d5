"""Spark-native activity and spatial analytics."""
