"""Mappings that are made once and read from a folder afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cells as cl
from ..operators import lines as ln
from ..operators.mapping import map_centroid
from .store import kept_mapping


def level_mapping(folder: str, fine: DataFrame, coarse: DataFrame, size: float, name: str = "levels", force: bool = False) -> DataFrame:
    """The mapping of a fine level to a coarse one by centroids, kept in the folder under the geometry of both."""
    return kept_mapping(folder, name, fine, coarse, lambda: map_centroid(fine, coarse, size), "centroid", force=force)


def cell_polygon_mapping(folder: str, cells: DataFrame, polygons: DataFrame, size: float, name: str = "cells_polygons", force: bool = False) -> DataFrame:
    """The mapping of cells (column ``cell``; repeated ones count once) to the polygons that hold their centres, kept likewise."""
    x, y = cl.centre(F.col("cell"))
    points = cells.select("cell").distinct().select(F.col("cell").alias("id"), x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))
    return level_mapping(folder, points, polygons, size, name, force)


def line_cell_mapping(folder: str, lines: DataFrame, centres: DataFrame, edge: float, margin: float = 10.0, name: str = "lines_cells", force: bool = False) -> DataFrame:
    """The pairs of lines (id, line) and cells (id, x, y of their centres) that samples of the lines are near, kept under
    both and the distances."""
    spots = centres.select("id", *(F.col(c).alias(b) for b, c in (("minx", "x"), ("miny", "y"), ("maxx", "x"), ("maxy", "y"))))
    build = lambda: ln.street_cell_mapping(lines, centres, edge, margin)
    return kept_mapping(folder, name, lines.select("id", "line"), spots, build, edge, margin, force=force)
