"""Rasters that follow arriving points."""
