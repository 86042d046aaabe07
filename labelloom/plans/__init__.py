"""Plans of the raster engine."""
