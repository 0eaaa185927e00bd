"""Spark-native scholarly retrieval, citation analysis and evaluation."""
