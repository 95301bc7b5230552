"""Measures of a single simple ring, an array of struct (x, y), as plain columns. Shapes of any kind and all that takes
two of them are in ``shapes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RING = "array<struct<x:double,y:double>>"


def each(points: Column, coordinate: str) -> Column:
    """One coordinate of all points of an array."""
    return F.transform(points, lambda p: p[coordinate])


def _edges(ring: Column) -> Column:
    """(x0, y0, x1, y1) of each edge; the last one leads back to the first corner."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _cross(e: Column) -> Column:
    return e["x0"] * e["y1"] - e["x1"] * e["y0"]


def signed_area(ring: Column) -> Column:
    return _total(F.transform(_edges(ring), _cross)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(F.transform(_edges(ring), lambda e: F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"])))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid; of a ring without area the mean of its corners."""
    whole = 6 * signed_area(ring)
    x = _total(F.transform(_edges(ring), lambda e: (e["x0"] + e["x1"]) * _cross(e)))
    y = _total(F.transform(_edges(ring), lambda e: (e["y0"] + e["y1"]) * _cross(e)))
    mean = [_total(each(ring, c)) / F.size(ring) for c in "xy"]
    return F.when(whole != 0, x / whole).otherwise(mean[0]), F.when(whole != 0, y / whole).otherwise(mean[1])


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether the closed polygon holds the point: on an edge, or an odd number of edges to the right."""

    def on(e: Column) -> Column:
        beside = (e["x1"] - e["x0"]) * (y - e["y0"]) == (e["y1"] - e["y0"]) * (x - e["x0"])
        return beside & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))

    def right(e: Column) -> Column:
        return ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])

    edges = _edges(ring)
    return F.exists(edges, on) | (F.size(F.filter(edges, right)) % 2 == 1)


def box_ring(prefix: str = "") -> Column:
    corners = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy")]
    return F.array(*(F.struct(F.col(prefix + x).alias("x"), F.col(prefix + y).alias("y")) for x, y in corners))


def with_bounds(layer: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds the bounds of the rings as the layer's box."""
    low = {c: F.array_min(each(F.col(ring), c)) for c in "xy"}
    high = {c: F.array_max(each(F.col(ring), c)) for c in "xy"}
    return layer.withColumns({"minx": low["x"], "miny": low["y"], "maxx": high["x"], "maxy": high["y"]})
