"""Streaming of the raster engine."""
