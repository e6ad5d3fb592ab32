"""Spatial habitat analytics as PySpark DataFrame operators."""
