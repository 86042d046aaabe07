"""Operators of the raster engine."""
