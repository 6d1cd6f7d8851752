"""Spark-native corpus analytics: speech and text tables as DataFrame-to-DataFrame operators."""
