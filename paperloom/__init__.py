"""Paperloom: document processing as Spark DataFrame operations."""
