"""Lectern: document-library analytics on PySpark."""
