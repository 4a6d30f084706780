"""Spark-native mining and retrieval over conversation logs and documents."""
