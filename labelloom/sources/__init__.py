"""Sources of the raster engine."""
