"""Spark-native engine for land-registry document records and corpus preparation."""
