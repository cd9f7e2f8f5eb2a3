"""Raster, phase and time-stack analytics on Spark DataFrames."""
