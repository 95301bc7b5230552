"""Mapping tables (src_id, dst_id, weight) between layers of boxes; a point is a box without extent, an axis-parallel line
one without area. Layers may have a column ``ring``, ``rings``, ``line``, ``lines`` or ``shape`` (see ``shapes``); a null
stands for the row's box. Pairs of boxes are settled by plain columns, others by one Arrow function.

Candidates come from equi-joins on grid bins of several widths: a box stands in the bins of the level at which it covers
few of them, whatever ``size``, and meets smaller boxes there. A pair is kept only in the bin of the lower-left corner of
the common part, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import FEW, cut, dealt, is_few
from . import shapes as sh

BOX = ("minx", "miny", "maxx", "maxy")


def _levelled(layer: DataFrame, size: float, prefix: str) -> DataFrame:
    """The layer's boxes with the level of their bins: bins of level l are size * 2 ** l wide."""
    names = ["id", *BOX, *(c for c in ("shape", "dim", "whole") if c in layer.columns)]
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    own = F.when(extent > 2 * size, F.ceil(F.log2(extent / (2 * size)))).otherwise(0).cast("int")
    return layer.select(own.alias("own"), *(F.col(c).alias(f"{prefix}_{c}") for c in names)).filter(F.col("own").isNotNull())


def _binned(layer: DataFrame, size: float, prefix: str, axes: str = "xy") -> DataFrame:
    """A row for each bin that a box covers at its column ``level``."""
    for axis in axes:
        side = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
        low, high = F.floor(F.col(f"{prefix}_min{axis}") / side), F.floor(F.col(f"{prefix}_max{axis}") / side)
        layer = layer.withColumn(f"b{axis}", F.explode(F.sequence(low, high)))
    return layer


def pairs(src: DataFrame, dst: DataFrame, size: float) -> DataFrame:
    """Each (src, dst) whose closed boxes meet, once, with both boxes and shapes."""
    s, d = _levelled(sh.shaped(src), size, "s"), _levelled(sh.shaped(dst), size, "d")
    load = lambda layer, side: F.lit(1) + (F.coalesce(F.size(F.flatten(f"{side}_shape")), F.lit(0)) if f"{side}_shape" in layer.columns else 0)
    loads = [layer.select(F.lit(side).alias("side"), "own", load(layer, side).alias("load")) for layer, side in ((s, "s"), (d, "d"))]
    found = loads[0].union(loads[1]).groupBy("side", "own").agg(F.sum("load").alias("load")).collect()  # a row for each power of two of box extents
    levels = {side: sorted(r["own"] for r in found if r["side"] == side) for side in "sd"}
    loads = {side: sum(r["load"] for r in found if r["side"] == side) for side in "sd"}  # rows and corners

    def at(layer: DataFrame, prefix: str, among: list[int], above: bool) -> DataFrame:
        """The layer at its own level, or at each level of ``among`` from there on."""
        if not among:
            lifted = layer.withColumn("level", F.col("own"))
        else:
            higher = F.filter(F.array(*(F.lit(x) for x in among)), lambda x: x > F.col("own") if above else x >= F.col("own"))
            lifted = layer.withColumn("level", F.explode(higher))
        return _binned(lifted, size, prefix).drop("own")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        few = min(loads.values()) <= FEW
        left, right = (left, dealt(right, few)) if loads["d"] <= loads["s"] else (dealt(left, few), right)
        out = left.join(right, ["level", "bx", "by"])
        for axis in "xy":
            low = F.greatest(f"s_min{axis}", f"d_min{axis}")
            side = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
            out = out.filter((low <= F.least(f"s_max{axis}", f"d_max{axis}")) & (F.col(f"b{axis}") == F.floor(low / side)))
        return out.drop("level", "bx", "by")

    if set(levels["s"]) | set(levels["d"]) <= {0}:
        return met(at(s, "s", [], False), at(d, "d", [], False))
    return met(at(s, "s", [], False), at(d, "d", levels["s"] or [0], False)).unionByName(met(at(s, "s", levels["d"] or [0], True), at(d, "d", [], False)))


def _extent(axis: str) -> Column:
    return F.least(f"s_max{axis}", f"d_max{axis}") - F.greatest(f"s_min{axis}", f"d_min{axis}")


def centroids(layer: DataFrame) -> DataFrame:
    """Polygons as their centroids; lines and points stay what they are."""
    layer = sh.shaped(layer)
    middle = {a: (F.col(f"min{a}") + F.col(f"max{a}")) / 2 for a in "xy"}
    polygon = sh.box_dim() == 2
    if "shape" in layer.columns:
        m = sh.measures("shape", "dim")
        polygon = F.col("dim") == 2
        layer = layer.withColumns({"_m": m})
        middle = {a: F.when(F.col("shape").isNull(), middle[a]).otherwise(F.col("_m")[f"c{a}"]) for a in "xy"}
    box = [F.when(polygon, middle[c[-1]]).otherwise(F.col(c)).alias(c) for c in BOX]
    rest = [F.when(~polygon, F.col("shape")).alias("shape"), F.when(polygon, 0).otherwise(F.col("dim")).alias("dim")] if "shape" in layer.columns else []
    return layer.select("id", *box, *rest)


def _side(met: DataFrame, prefix: str) -> tuple[Column, Column]:
    """Shape and dimension of a side."""
    shape, dim = sh.box_shape(f"{prefix}_"), sh.box_dim(f"{prefix}_")
    if f"{prefix}_shape" not in met.columns:
        return shape, dim
    return F.coalesce(f"{prefix}_shape", shape), F.coalesce(f"{prefix}_dim", dim)


def _shapely(met: DataFrame) -> Column | None:
    """Whether a side of the pair is no box; None if neither layer has shapes."""
    found = [F.col(c).isNotNull() for c in ("s_shape", "d_shape") if c in met.columns]
    return None if not found else found[0] if len(found) == 1 else found[0] | found[1]


def weighed(layer: DataFrame) -> DataFrame:
    """The layer with ``whole``: the area of polygons, the length of lines, 0 for points."""
    layer = sh.shaped(layer)
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    box = F.when(sh.box_dim() == 2, w * h).otherwise(w + h)
    if "shape" not in layer.columns:
        return layer.withColumn("whole", box)
    m = sh.measures("shape", "dim")
    return layer.withColumn("_m", m).withColumn("whole", F.when(F.col("shape").isNull(), box).when(F.col("dim") == 2, F.col("_m.area")).otherwise(F.col("_m.length"))).drop("_m")


def related(src: DataFrame, dst: DataFrame, size: float) -> DataFrame:
    """src_id, dst_id, s_dim, d_dim, whole, part of each pair that meets, contacts included: the part of the src (area, length;
    1 for points) that lies in the dst. Areas below a share of 1e-12 are contacts."""
    met = pairs(weighed(src), dst, size)
    (s, sd), (d, dd) = _side(met, "s"), _side(met, "d")
    low, high = F.least(sd, dd), F.greatest(sd, dd)
    boxes = F.when(low == 2, _extent("x") * _extent("y")).when((sd == 1) & (high == 2), _extent("x") + _extent("y")).when((sd == 1) & (dd == 1), _extent("x") + _extent("y")).when(sd == 0, 1.0).otherwise(0.0)
    names = [F.col("s_id").alias("src_id"), F.col("d_id").alias("dst_id"), sd.alias("s_dim"), dd.alias("d_dim"), F.col("s_whole").alias("whole")]
    shaped = _shapely(met)
    if shaped is None:
        return met.select(*names, boxes.alias("part"))
    found = sh.relation(F.when(shaped, s), sd, F.when(shaped, d), dd)
    rows = met.select(*names, shaped.alias("_shaped"), boxes.alias("_boxes"), found.alias("_found"))
    part = F.when(F.col("_found.part") > F.col("whole") * 1e-12, F.col("_found.part")).otherwise(0.0)
    part = F.when(F.col("_shaped"), part).otherwise(F.col("_boxes"))
    return rows.filter(~F.col("_shaped") | F.col("_found.meets")).withColumn("part", part).drop("_shaped", "_boxes", "_found")


def map_centroid(src: DataFrame, dst: DataFrame, size: float) -> DataFrame:
    """One dst for each src: the smallest id among those that hold its centroid, borders included, or, for lines and points,
    that they meet. Points at one place and rows of one shape, which stand for the smallest of their ids, are met once."""
    points, dst = centroids(src), sh.shaped(dst)
    if "shape" in points.columns:
        points = cut(points)  # centroids are computed once
    dim = F.coalesce("dim", sh.box_dim()) if "shape" in points.columns else sh.box_dim()
    lines = points.filter(dim > 0)
    some = bool(lines.take(1))
    if some or "shape" in points.columns:
        points = points.filter(dim == 0).drop("shape", "dim")
    places = points.select(F.struct(*BOX).alias("id"), *BOX).distinct()
    met = pairs(places, dst.groupBy(*(c for c in (*BOX, "shape", "dim") if c in dst.columns)).agg(F.min("id").alias("id")), size)
    if "d_shape" in met.columns:
        met = met.withColumn("_in", sh.holds("d_shape", "d_dim", "s_minx", "s_miny")).filter(F.col("d_shape").isNull() | F.col("_in"))
    first = met.groupBy("s_id").agg(F.min("d_id").alias("dst_id")).select("s_id.*", "dst_id")
    met = points.join(dealt(first, is_few(places)), list(BOX)).select(F.col("id").alias("src_id"), "dst_id")
    if some:
        met = met.unionByName(related(lines, dst, size).select("src_id", "dst_id"))
    return met.groupBy("src_id").agg(F.min("dst_id").alias("dst_id")).withColumn("weight", F.lit(1.0))


def map_touches(src: DataFrame, dst: DataFrame, size: float) -> DataFrame:
    """Each dst that holds the whole src; the weight is shared evenly."""
    met = related(src, dst, size)
    within = F.when(F.col("s_dim") == 0, True).otherwise((F.col("d_dim") >= F.col("s_dim")) & (F.col("part") >= F.col("whole") * (1 - 1e-9)))
    return met.filter(within).select("src_id", "dst_id").withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("src_id")))


def map_intersects(src: DataFrame, dst: DataFrame, size: float) -> DataFrame:
    """Each dst that the src meets, contacts included, with weight 1."""
    return related(src, dst, size).select("src_id", "dst_id", F.lit(1.0).alias("weight"))


def map_exact(src: DataFrame, dst: DataFrame, size: float) -> DataFrame:
    """The share of the src's area (of lines: length) inside each dst; contacts without extent stay with weight 0, points
    have weight 1."""
    share = F.when(F.col("s_dim") == 0, 1.0).when(F.col("whole") > 0, F.col("part") / F.col("whole")).otherwise(0.0)
    return related(src, dst, size).select("src_id", "dst_id", share.alias("weight"))


#: Names of the modes.
MODES = {"centroid": map_centroid, "touches": map_touches, "contains": map_touches, "intersects": map_intersects, "exact": map_exact}


def id_mapping(src: DataFrame, dst: DataFrame, size: float, geoweighted: bool = False, mode: str | None = None) -> DataFrame:
    """The mapping of a mode; without one, ``exact`` if geoweighted, else ``centroid``."""
    mode = mode or ("exact" if geoweighted else "centroid")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {sorted(MODES)}")
    return MODES[mode](src, dst, size)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct (src_id, dst_id) over a shared middle id."""
    return first.select("src_id", F.col("dst_id").alias("mid")).join(second.select(F.col("src_id").alias("mid"), "dst_id"), "mid").select("src_id", "dst_id").distinct()
