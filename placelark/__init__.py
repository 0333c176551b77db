"""Geocoding analytics on Spark DataFrames."""
