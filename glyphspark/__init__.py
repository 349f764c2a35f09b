"""Conversion between Chinese script and regional variants, and detection of them, on Spark DataFrames."""

__version__ = "0.1.0"
