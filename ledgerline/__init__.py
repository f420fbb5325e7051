"""Spark-native analytics for account ledgers."""
