"""Spark-native dialogue dataset building and paired model evaluation."""
