"""Lectern: a PySpark-native analytics engine for assessment content and its source documents."""
