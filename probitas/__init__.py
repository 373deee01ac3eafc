"""Spark-native analytics for auditing the free-text answers of question-answering models."""
