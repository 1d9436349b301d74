"""Approximate analytics on Spark: mergeable summaries kept as ordinary DataFrames."""

__version__ = "0.1.0"
