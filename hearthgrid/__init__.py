"""Spark-native demand-response analytics for household meter data."""
