"""Gristmill: similarity, lookup and clean-up operators over Spark DataFrames."""

__version__ = "0.1.0"
