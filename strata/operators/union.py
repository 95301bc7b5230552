"""Dissolving polygons by a group: sides that two polygons of a group share cancel each other, and what is left is stitched
to rings. Everything is a join or a grouping of edges; only the corners of one ring ever come together in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..scratch import cut, numbered
from . import mapping as mp
from . import shapes as sh

_ENDS = ("x0", "y0", "x1", "y1")
_SIDES = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in _ENDS]))


def oriented(s: sh.Shapes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edges of polygons with the inner side on their left."""
    flip = np.zeros(len(s.row), bool)
    work, low = np.cumsum(np.diff(s.starts()) ** 2 + 1), 0
    while low < s.rows:  # an even number of edges below (or to the left of) its middle: the inner side is above
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + sh.PAIRS, "right")))
        p = s.some(low, high)
        i, j = sh._met(p.row, p.starts())
        i, j = i[i != j], j[i != j]
        steep = p.x0 == p.x1
        ax, ay, bx, by = (np.where(steep[i], v, w) for v, w in ((p.y0[j], p.x0[j]), (p.x0[j], p.y0[j]), (p.y1[j], p.x1[j]), (p.x1[j], p.y1[j])))
        mx, my = (p.x0 + p.x1) / 2, (p.y0 + p.y1) / 2
        x, y = np.where(steep[i], my[i], mx[i]), np.where(steep[i], mx[i], my[i])
        with np.errstate(divide="ignore", invalid="ignore"):
            below = ((ax > x) != (bx > x)) & (ay + (by - ay) * ((x - ax) / (bx - ax)) < y)
        odd = np.bincount(i[below], minlength=len(p.row)) % 2 == 1
        rising = np.where(steep, p.y1 < p.y0, p.x1 > p.x0)  # to the right, or for upright edges down
        at = np.searchsorted(s.row, low)
        flip[at : at + len(p.row)] = rising == odd
        low = high
    return tuple(np.where(flip, b, a) for a, b in ((s.x0, s.x1), (s.y0, s.y1), (s.x1, s.x0), (s.y1, s.y0)))


@F.arrow_udf(_SIDES)
def outline(shape: pa.Array, dim: pa.Array) -> pa.Array:
    """The edges of polygons as an array, the inner side on their left."""
    s = sh.flat(shape, dim)
    return pa.ListArray.from_arrays(pa.array(s.starts(), pa.int32()), pa.StructArray.from_arrays([pa.array(e) for e in oriented(s)], list(_ENDS)))


def _cut_at_corners(edges: DataFrame, size: float) -> DataFrame:
    """The edges in pieces between the corners of the group that lie on them, so that sides shared in part match."""
    box = {f"{side}{c}": f(f"{c}0", f"{c}1") for side, f in (("min", F.least), ("max", F.greatest)) for c in "xy"}
    named = edges.withColumns({**box, "id": F.struct("group", "edge", *_ENDS)})
    spots = edges.select("group", F.col("x0").alias("x"), F.col("y0").alias("y")).union(edges.select("group", "x1", "y1")).distinct()
    spots = spots.select(F.struct("group", "x", "y").alias("id"), *(F.col(c[-1]).alias(c) for c in mp.BOX))
    met = mp.pairs(spots, named, size).filter(F.col("s_id")["group"].eqNullSafe(F.col("d_id")["group"]))
    e, x, y = F.col("d_id"), F.col("s_minx"), F.col("s_miny")
    dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
    t = ((x - e["x0"]) * dx + (y - e["y0"]) * dy) / (dx * dx + dy * dy)
    extent = F.greatest(*(F.abs(e[c]) for c in _ENDS))
    on = F.abs(dx * (y - e["y0"]) - dy * (x - e["x0"])) <= sh.SLACK * extent * F.hypot(dx, dy)
    hits = met.filter(on & (t >= 0) & (t <= 1)).select(e["group"].alias("group"), e["edge"].alias("edge"), t.alias("t"), x.alias("x0"), y.alias("y0"))
    order = Window.partitionBy("edge").orderBy("t")
    pieces = hits.withColumns({"x1": F.lead("x0").over(order), "y1": F.lead("y0").over(order)})
    return pieces.filter("x1 is not null").select("group", *_ENDS)


def outlines(layer: DataFrame, group: str, size: float) -> DataFrame:
    """group, ring_id, ring (closed arrays of struct x, y) of the union of each group's polygons, a row for each ring.

    Polygons of a group may share sides, whole or in part, and corners, but must not overlap; holes that remain are rings of
    their own. Rows of a null group form one; lines, points and null shapes have no sides. ``size``: width of the finest
    bins, near the length of common sides.
    """
    layer = sh.shaped(layer)
    shape, dim = (F.coalesce("shape", sh.box_shape()), F.coalesce("dim", sh.box_dim())) if "shape" in layer.columns else (sh.box_shape(), sh.box_dim())
    polygons = layer.select(F.col(group).alias("group"), shape.alias("shape"), dim.alias("dim")).filter("dim = 2 and shape is not null")
    edges = numbered(polygons.select("group", F.explode(outline("shape", "dim")).alias("e")).select("group", "e.*"), "edge")
    pieces = _cut_at_corners(edges, size)
    # each piece in the direction of its ends, counted by how often it is passed that way
    swap = F.struct("x0", "y0") > F.struct("x1", "y1")
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (("x0", "x1", "x0"), ("y0", "y1", "y0"), ("x1", "x0", "x1"), ("y1", "y0", "y1"))]
    counted = pieces.select("group", *ends, F.when(swap, -1).otherwise(1).alias("way")).groupBy("group", *_ENDS).agg(F.sum("way").alias("way"))
    ends = [F.when(F.col("way") < 0, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))]
    left = numbered(counted.filter("way <> 0").select("group", *ends), "piece")
    # the next piece: of those that start at the end, the one that turns most to the left, so that parts with a corner in common stay apart
    after = left.select(F.col("group").alias("_g"), F.col("piece").alias("next"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    met = left.join(after, ["x1", "y1"]).filter(F.col("group").eqNullSafe(F.col("_g")))
    ux, uy, vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    links = cut(met.groupBy("piece").agg(F.max_by("next", F.struct(turn, "next")).alias("next")))
    # rings by pointer jumping: after k rounds the label is the smallest number among 2 ** k followers
    jumps = links.select("piece", F.least("piece", "next").alias("label"), "next")
    while True:
        ahead = jumps.select(F.col("piece").alias("next"), F.col("label").alias("_label"), F.col("next").alias("_next"))
        moved = cut(jumps.join(ahead, "next").select("piece", F.least("label", "_label").alias("label"), F.col("_next").alias("next"), (F.col("_label") < F.col("label")).alias("fell")))
        jumps = moved.drop("fell")
        if not moved.filter("fell").take(1):
            break
    rows = left.join(links, "piece").join(jumps.select("piece", F.col("label").alias("ring_id")), "piece")
    kind = layer.schema[group].dataType

    def walk(table: pa.Table) -> pa.Table:
        """The corners of one ring in their order."""
        piece, follow = (table.column(c).to_numpy() for c in ("piece", "next"))
        order = np.argsort(piece)
        at = order[np.searchsorted(piece, follow, sorter=order)]
        path, k = [int(order[0])], int(at[order[0]])
        while k != path[0]:
            path.append(k)
            k = int(at[k])
        path.append(path[0])
        corners = pa.StructArray.from_arrays([table.column(c).combine_chunks().take(pa.array(path)) for c in ("x0", "y0")], ["x", "y"])
        ring = pa.ListArray.from_arrays(pa.array([0, len(path)], pa.int32()), corners)
        return pa.table({"group": table.column("group").slice(0, 1), "ring_id": table.column("ring_id").slice(0, 1), "ring": ring})

    schema = T.StructType([T.StructField("group", kind), T.StructField("ring_id", T.LongType()), T.StructField("ring", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))])
    return rows.select("group", "ring_id", "piece", "next", "x0", "y0").groupBy("ring_id").applyInArrow(walk, schema).withColumnRenamed("group", group)


def dissolved(layer: DataFrame, group: str, size: float) -> DataFrame:
    """One polygon for each group: id (the group), shape, dim and bounds."""
    rings = outlines(layer, group, size).groupBy(F.col(group).alias("id")).agg(F.array_sort(F.collect_list("ring")).alias("rings"))
    return sh.shaped(rings)
