"""Spark-native analytics over documents, annotations and knowledge graphs."""
