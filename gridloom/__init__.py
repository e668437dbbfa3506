"""Point tables to feature rasters, as lazy DataFrame plans."""
