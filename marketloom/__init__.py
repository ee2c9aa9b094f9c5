"""Spark-native analytics for daily market panels, text streams and training corpora."""
