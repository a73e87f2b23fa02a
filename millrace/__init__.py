"""Millrace: a PySpark-native engine for document, search, vector, graph and corpus queries."""
