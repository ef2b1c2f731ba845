"""Sketch-based traffic analytics on PySpark."""
