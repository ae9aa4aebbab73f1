"""Spark-native engine that turns collections of long documents into queryable tables."""

__version__ = "0.1.0"
