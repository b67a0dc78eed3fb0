"""Spark-native analytics for image-annotation datasets."""
