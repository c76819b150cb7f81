"""Palimpsest: a PySpark-native engine for building and searching personal archives."""
