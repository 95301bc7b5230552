"""K-nearest mappings, smooth means and policies for cells without data, on points (minx, miny of a layer).

``nearest`` meets the coarse side in 3 x 3 grid bins first. Points whose k-th hit is not certain then descend a pyramid of the
coarse side's bins: counts and tight bounds tell which bins may still hold one of the k nearest, however far they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.measures import local_utm
from ..functions.strategies import clean, weighted_mean
from ..scratch import cut

FEW = 2048
BINS = 50_000  # bins of a level that go to each task
CROWD = 64  # points a bin of the lowest level should hold, if a bin's points are spread evenly


def _among_few(s: DataFrame, dst: DataFrame, few: list, k: int) -> DataFrame:
    """sx, sy, dst_id, distance of the k nearest of at most FEW points, which go to each task."""
    few = sorted(few, key=lambda r: r["id"])  # equal distances keep the order of the ids
    x, y = np.array([r["dx"] for r in few]), np.array([r["dy"] for r in few])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                far = np.hypot(part.column(0).to_numpy()[:, None] - x, part.column(1).to_numpy()[:, None] - y)
                best = np.argsort(far, axis=1, kind="stable")[:, :k]
                rows = pa.array(np.repeat(np.arange(part.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(best.ravel()), pa.array(np.take_along_axis(far, best, 1).ravel())], ["sx", "sy", "at", "distance"])

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("dst_id", dst.schema["id"].dataType)])
    names = s.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(few)], schema)
    return s.mapInArrow(run, "sx double, sy double, at long, distance double").join(F.broadcast(names), "at").select("sx", "sy", "dst_id", "distance")


def _descend(open_: DataFrame, d: DataFrame, size: float, wanted: int) -> DataFrame:
    """sx, sy, dx, dy, ids: for each open point the destinations that may be among its ``wanted`` nearest.

    Level by level, four times finer each, a point keeps the bins that are not farther than the distance within which enough
    destinations lie for sure. That is a handful of bins a point, wherever it is and however the destinations crowd.
    """
    x, y = F.col("dx"), F.col("dy")
    bins = d.groupBy(F.floor(x / size), F.floor(y / size)).agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    crowd, *box = bins.agg(F.max("n"), F.min("a"), F.max("b"), F.min("c"), F.max("d")).first()
    extent = max(box[1] - box[0], box[3] - box[2])
    side = size / 4 ** min(8, max(0, math.ceil(math.log(crowd / CROWD, 16))))
    base = cut(d.withColumns({"bx": F.floor(F.col("dx") / side), "by": F.floor(F.col("dy") / side), "n": F.size("ids").cast("long")}))
    top = min(31, max(0, math.ceil(math.log(max(extent, side) / side, 4))))  # at most four bins
    bounds = {"low_x": F.min("low_x"), "high_x": F.max("high_x"), "low_y": F.min("low_y"), "high_y": F.max("high_y"), "n": F.sum("n")}
    lowest = base.groupBy("bx", "by").agg(F.min("dx").alias("low_x"), F.max("dx").alias("high_x"), F.min("dy").alias("low_y"), F.max("dy").alias("high_y"), F.sum("n").alias("n"))
    levels = lowest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumns({c: F.expr(f"shiftright({c}, 2 * level)") for c in ("bx", "by")})
    cells = cut(levels.groupBy("level", "bx", "by").agg(*(v.alias(c) for c, v in bounds.items())))
    counts = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}  # a row a level
    pairs = open_.withColumns({"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long")})  # all bins of the top level have one parent
    point = Window.partitionBy("sx", "sy")
    so_far = F.sum("n").over(point.orderBy("far", "bx", "by").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    off = lambda low, high, at: (F.greatest(F.col(low) - F.col(at), F.col(at) - F.col(high), F.lit(0.0)), F.greatest(F.abs(F.col(low) - F.col(at)), F.abs(F.col(high) - F.col(at))))
    (near_x, far_x), (near_y, far_y) = off("low_x", "high_x", "sx"), off("low_y", "high_y", "sy")
    for level in range(top, -1, -1):
        bins = cells.filter(F.col("level") == level).drop("level").withColumns({p: F.shiftright(c, 2) if level < top else F.lit(0).cast("long") for p, c in (("px", "bx"), ("py", "by"))})
        met = pairs.join(F.broadcast(bins) if counts.get(level, 0) <= BINS else bins, ["px", "py"])
        met = met.withColumns({"near": F.hypot(near_x, near_y), "far": F.hypot(far_x, far_y)}).withColumn("so_far", so_far)
        enough = met.withColumn("enough", F.min(F.when(F.col("so_far") >= wanted, F.col("far"))).over(point))
        pairs = enough.filter(F.col("near") <= F.col("enough") * (1 + 1e-12)).select("sx", "sy", F.col("bx").alias("px"), F.col("by").alias("py"))
        pairs = cut(pairs) if level % 4 == 3 else pairs  # plans of bounded depth
    return pairs.join(base.select(F.col("bx").alias("px"), F.col("by").alias("py"), "dx", "dy", "ids"), ["px", "py"]).drop("px", "py")


def nearest(src: DataFrame, dst: DataFrame, size: float, k: int = 1) -> DataFrame:
    """src_id, dst_id, distance of the k nearest dst points (all, if there are fewer); ties go to the smaller id.

    Every source with coordinates is mapped, however far. At most FEW destinations go to each task as they are. Else bins of
    ``size`` serve the sources that have k destinations within it, and a pyramid of bins the others; points of equal
    coordinates meet as one, with their k smallest ids.
    """

    def at(low: str, high: str) -> Column:
        return (F.col(low) + F.col(high)) / 2

    def points(layer: DataFrame, x: str, y: str) -> DataFrame:
        found = layer.select("id", at("minx", "maxx").alias(x), at("miny", "maxy").alias(y))
        return found.filter(F.abs(x) < float("inf")).filter(F.abs(y) < float("inf"))  # no nulls, NaN and infinite values

    members, goals = points(src, "sx", "sy"), points(dst, "dx", "dy")
    few = goals.limit(FEW + 1).collect()
    s = members.select("sx", "sy").distinct()
    if 0 < len(few) <= FEW:
        return members.join(_among_few(s, dst, few, k), ["sx", "sy"]).select(F.col("id").alias("src_id"), "dst_id", "distance")
    place = F.row_number().over(Window.partitionBy("dx", "dy").orderBy("id"))
    d = goals.withColumn("place", place).filter(F.col("place") <= k).groupBy("dx", "dy").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # one row: how many destinations there are, and how wide both layers are
    sides = members.select(F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(0).alias("n")).union(goals.select("dx", "dy", F.lit(1)))
    count, *box = sides.agg(F.sum("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wanted = max(1, min(k, count or 0))
    extent = 0.0 if box[0] is None else math.hypot(box[1] - box[0], box[3] - box[2])
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))
    reach = d.withColumn("bx", span("dx")).withColumn("by", span("dy"))
    met = s.withColumns({"bx": F.floor(F.col("sx") / size), "by": F.floor(F.col("sy") / size)}).join(reach, ["bx", "by"])

    def best(met: DataFrame, within: float | None) -> DataFrame:
        near = met.withColumn("distance", F.hypot(F.col("sx") - F.col("dx"), F.col("sy") - F.col("dy")))
        near = near if within is None else near.filter(F.col("distance") <= within)
        each = near.select("sx", "sy", "distance", F.explode("ids").alias("dst_id"))
        first = each.withColumn("rank", F.row_number().over(Window.partitionBy("sx", "sy").orderBy("distance", "dst_id"))).filter(F.col("rank") <= k)
        return cut(first.groupBy("sx", "sy").agg(F.array_sort(F.collect_list(F.struct("rank", "dst_id", "distance"))).alias("hits")).filter(F.size("hits") >= wanted))

    covered = size >= extent
    done = best(met, None if covered else size)
    if count and not covered:
        open_ = cut(s.join(done.select("sx", "sy"), ["sx", "sy"], "left_anti"))
        if open_.take(1):
            done = done.unionByName(best(_descend(open_, d, size, wanted), None))
    hits = done.select("sx", "sy", F.explode("hits").alias("hit"))
    return members.join(hits, ["sx", "sy"]).select(F.col("id").alias("src_id"), "hit.dst_id", "hit.distance")


def knn_mapping(src: DataFrame, dst: DataFrame, size: float, k: int = 6, power: float = 2.0, areas: bool = False) -> DataFrame:
    """src_id, dst_id, weight: inverse distance weights that sum to 1 for each src. With ``areas`` (a column of both
    layers) also src_area and dst_area."""
    raw = F.pow(F.col("distance") + 1e-9, F.lit(-power))
    weight = F.col("raw") / F.sum("raw").over(Window.partitionBy("src_id"))  # k rows each
    out = nearest(src, dst, size, max(1, k)).withColumn("raw", raw).select("src_id", "dst_id", weight.alias("weight"))
    if not areas:
        return out
    of = lambda layer, side: layer.select(F.col("id").alias(f"{side}_id"), F.col("area").alias(f"{side}_area"))
    return out.join(of(src, "src"), "src_id").join(of(dst, "dst"), "dst_id").select("src_id", "dst_id", "weight", "src_area", "dst_area")


def smooth_mean(mapping: DataFrame, coarse: DataFrame, value: str) -> DataFrame:
    """Blend of the neighbours' values, renormalised over those that are there; null without any."""
    joined = mapping.join(coarse.select(F.col("id").alias("dst_id"), clean(value).alias("v")), "dst_id")
    den = F.sum(F.when(F.col("v").isNotNull(), F.col("weight")))
    return joined.groupBy(F.col("src_id").alias("id")).agg(F.when(den > 0, F.sum(F.col("v") * F.col("weight")) / den).alias(value))


def empty_mask(columns: list[str]) -> Column:
    """Rows without a value in any of the columns."""
    return reduce(lambda a, b: a & b, (clean(c).isNull() for c in columns))


def _sides(layer: DataFrame, none: Column, weight: str, crs: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows to serve and rows that serve; degrees (EPSG:4326) become metres in the UTM zone of the layer's middle."""
    layer = cut(local_utm(layer)) if crs and crs.upper() == "EPSG:4326" else layer  # the series is computed once
    return layer.filter(none & (F.col(weight) > 0)), layer.filter(~none)


def fill_from_nearest(layer: DataFrame, value: str | list[str], weight: str, size: float, most: float | None = None, filled: str = "filled", crs: str | None = None) -> DataFrame:
    """Rows without any of the values but weight over 0 take all of them from the nearest row that has one; ``filled``
    marks them. With ``crs`` EPSG:4326, ``size`` and ``most`` are metres."""
    values = [value] if isinstance(value, str) else list(value)
    none = empty_mask(values)
    empty, full = _sides(layer, none, weight, crs)
    near = nearest(empty, full, size)
    near = near if most is None else near.filter(F.col("distance") <= most)
    donors = full.select(F.col("id").alias("dst_id"), F.struct(*(clean(c).alias(c) for c in values)).alias("_given"))
    given = near.join(donors, "dst_id").select(F.col("src_id").alias("id"), "_given")
    out = layer.join(given, "id", "left").withColumn(filled, F.col("_given").isNotNull())
    return out.withColumns({c: F.coalesce(clean(c), F.col("_given")[c]) for c in values}).drop("_given")


def relocate_weight(layer: DataFrame, value: str | list[str], weight: str, size: float, most: float = 300.0, crs: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Weight of rows without value goes to the nearest row with one; second, the total beyond ``most`` (one row). With ``crs``
    EPSG:4326, ``size`` and ``most`` are metres."""
    none = empty_mask([value] if isinstance(value, str) else list(value))
    empty, full = _sides(layer, none, weight, crs)
    near = cut(nearest(empty, full, size).filter(F.col("distance") <= most))
    moved = near.join(empty.select(F.col("id").alias("src_id"), F.col(weight).alias("w")), "src_id")
    gains = moved.groupBy(F.col("dst_id").alias("id")).agg(F.sum("w").alias("gain"))
    out = layer.join(gains, "id", "left").withColumn(weight, F.when(none, F.lit(0.0)).otherwise(F.col(weight) + F.coalesce("gain", F.lit(0.0)))).drop("gain")
    lost = empty.join(near.select(F.col("src_id").alias("id")), "id", "left_anti").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("excluded"))
    return out, lost


def handle_empty(layer: DataFrame, value: str | list[str], weight: str, size: float, method: str = "nearest_value", most: float | None = None, crs: str | None = None) -> DataFrame:
    """Rows without a value by a method: nearest_value, relocate or ignore."""
    if method == "nearest_value":
        return fill_from_nearest(layer, value, weight, size, most, crs=crs)
    if method == "relocate":
        return relocate_weight(layer, value, weight, size, 300.0 if most is None else most, crs)[0]
    if method == "ignore":
        return layer
    raise ValueError(f"unknown method {method}; one of nearest_value, relocate, ignore")


def group_means(layer: DataFrame, value: str, weight: str, groups: list[str] | None = None) -> DataFrame:
    """Weighted means of the rows with a value, over all or by groups; null where these have no weight."""
    return layer.groupBy(*(groups or [])).agg(weighted_mean(value, weight).alias(value))
