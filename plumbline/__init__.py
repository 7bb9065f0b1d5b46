"""Plumbline: evidence analytics on Spark DataFrames."""
