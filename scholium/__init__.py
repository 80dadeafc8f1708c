"""Spark-native analytics over document-metadata corpora."""
