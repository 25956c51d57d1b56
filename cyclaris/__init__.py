"""Spark-native analytics for symmetries of circular nucleotide sequences."""

__version__ = "0.1.0"
