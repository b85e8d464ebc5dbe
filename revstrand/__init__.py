"""Spark-native analytics for folded long reads and inverted repeats."""

__version__ = "0.1.0"
