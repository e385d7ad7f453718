"""Bulk identity data on Spark: read, map, validate, merge, join, load and analyse user records as DataFrames."""
