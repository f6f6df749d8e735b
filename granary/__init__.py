"""Granary: PySpark operators that select, order and weight training data."""

__version__ = "0.1.0"
