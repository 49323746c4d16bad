"""Spark-first engine for scanning, binding, comparing and writing workbook data."""

__version__ = "0.1.0"
