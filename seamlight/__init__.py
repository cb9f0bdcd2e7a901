"""Spark-native hybrid retrieval, object, graph and sync operators over DataFrames."""

__version__ = "0.1.0"
