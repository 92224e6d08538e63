"""Corvex: routed full-text search and records analytics on PySpark DataFrames."""
