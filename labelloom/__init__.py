"""Spark-native analytics for labelled rasters and the objects in them."""
