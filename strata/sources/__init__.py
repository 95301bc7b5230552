"""Layers and rasters from tables."""
