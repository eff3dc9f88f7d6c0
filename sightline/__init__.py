"""Spark-native engine for searching collections of detected objects in images."""
