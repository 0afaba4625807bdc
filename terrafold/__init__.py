"""Geospatial analytics over Spark DataFrames."""
