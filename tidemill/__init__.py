"""Spark-native engine for postings analytics and training-data preparation."""
