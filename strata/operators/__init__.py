"""Spatial operators over DataFrames."""
