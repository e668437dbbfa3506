"""Functions on rasters and points as images and directions."""
