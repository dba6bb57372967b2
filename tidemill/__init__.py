"""Spark-native analytics for timestamped economic releases and market prices."""
