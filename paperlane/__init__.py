"""Paperlane: document analytics as PySpark DataFrame operators."""
