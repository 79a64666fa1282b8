"""Governed document retrieval and text data processing as PySpark plans."""
