"""Spark-native retrieval, question-answering analytics and evaluation."""
