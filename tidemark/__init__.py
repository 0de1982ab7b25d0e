"""Timed-evidence analytics on Spark DataFrames."""
