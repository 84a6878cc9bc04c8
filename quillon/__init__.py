"""Quillon: promo-code, order and request analytics on PySpark DataFrames."""

__version__ = "0.1.0"
