"""Tessella: document-intelligence analytics as PySpark DataFrame operators."""
