"""Spark-native analytics for streams of sparse point observations (frames)."""

__version__ = "0.1.0"
