"""Palimpsest: a PySpark-native engine for analysing change in collections of documents."""

__version__ = "0.1.0"
