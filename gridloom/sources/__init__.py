"""Where points come from and rasters go."""
