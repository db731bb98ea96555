"""Spark-native data profiling, quality and relationship analysis."""

__version__ = "0.1.0"
