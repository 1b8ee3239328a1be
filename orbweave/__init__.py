"""Spatial mapping and corpus preparation on Spark DataFrames."""
