"""Spark-native parts-catalogue data engine."""
