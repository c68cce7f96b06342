"""Spark-native analytics over versioned trees of source modules and descriptors."""

__version__ = "0.1.0"
