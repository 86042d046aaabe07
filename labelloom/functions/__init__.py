"""Functions of the raster engine."""
