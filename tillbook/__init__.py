"""Retail sales reports as lazy Spark DataFrames."""

from tillbook.model import RetailModel

__all__ = ["RetailModel"]
