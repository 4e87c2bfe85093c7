"""Joinable-table discovery over a data lake, as composable PySpark operators."""

__version__ = "0.1.0"
