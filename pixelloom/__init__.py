"""Raster analytics on PySpark: images and pixels as DataFrames."""
