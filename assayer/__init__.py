"""Spark-native profiling, cataloguing, lineage and search over a data estate."""

__version__ = "0.1.0"
