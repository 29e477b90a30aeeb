"""Raster analytics on Spark: images as DataFrames of pixels, blocks and tokens."""
