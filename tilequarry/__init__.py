"""Spark-native geospatial vector retrieval, its evaluation, and training-data operators."""
