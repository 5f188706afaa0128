"""Spark-native functional data analysis: curves as values in DataFrames."""

__version__ = "0.1.0"
