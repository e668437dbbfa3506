"""Operators on point tables and rasters: each takes and returns lazy DataFrames."""
