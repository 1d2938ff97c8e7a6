"""Spark-native analytics for building and scoring retrieval question-answering benchmarks."""
