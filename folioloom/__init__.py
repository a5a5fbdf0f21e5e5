"""Folioloom: a PySpark engine for document analytics and retrieval."""
