"""Lines (id, line: array of struct x, y): samples along them, distance joins to cells and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.strategies import Max, Mean, Strategy
from ..levels import Levels
from ..scratch import cut, dealt, is_few
from . import mapping as mp
from . import nearest as nr
from .shapes import GEOMETRIES


def segments(lines: DataFrame) -> DataFrame:
    """id, place, x0, y0, x1, y1 of each piece between two corners; other columns stay."""
    rest = [c for c in lines.columns if c != "line"]
    step = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line")), lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
    long_ = lines.filter(F.size("line") > 1)
    return long_.select(*rest, F.posexplode(step).alias("place", "s")).select(*rest, "place", "s.*")


def densify(lines: DataFrame, step: float) -> DataFrame:
    """Samples (x, y) of each line, at most ``step`` apart: from each corner on max(1, ceil(length / step)) a piece, and the
    last corner. Other columns stay."""
    if step <= 0:
        raise ValueError("the step must be over 0")
    rest = [c for c in lines.columns if c != "line"]
    cut = segments(lines).withColumn("n", F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / step)).cast("int"))
    t = F.col("k") / F.col("n")
    inner = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*rest, (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))
    last = lines.filter(F.size("line") > 0).withColumn("p", F.element_at("line", -1)).select(*rest, "p.x", "p.y")
    return inner.unionByName(last)


def within(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Pairs of a centre (id, x, y) and the points (x, y and others) at most ``radius`` away: bins as wide as the radius, so
    a centre meets 3 x 3 of them."""
    if radius <= 0:
        raise ValueError("the radius must be over 0")
    place = lambda c, d=0: (F.floor(F.col(c) / radius) + d)
    near = centres.select(F.col("id").alias("centre"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = near.withColumn("bx", F.explode(F.sequence(place("cx", -1), place("cx", 1)))).withColumn("by", F.explode(F.sequence(place("cy", -1), place("cy", 1))))
    met = points.withColumns({"bx": place("x"), "by": place("y")}).join(dealt(near, is_few(centres)), ["bx", "by"])
    distance = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    return met.withColumn("distance", distance).filter(F.col("distance") <= radius).drop("bx", "by", "cx", "cy")


def _alike(centres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, x, y) of groups and (id, group) of cells: cells at the same places are a group, so that samples meet them once."""
    sets = centres.filter("x is not null and y is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("places"))
    groups = cut(sets.select("places").distinct().withColumn("group", F.monotonically_increasing_id()))
    return groups.select(F.col("group").alias("id"), F.inline("places")), sets.join(dealt(groups, is_few(groups)), "places").select("id", "group")


def edges_to_cells(lines: DataFrame, centres: DataFrame, columns: list[str], edge: float, margin: float = 10.0, strategies: Strategy | dict[str, Strategy] | None = None, fallback: float | None = 5.0) -> DataFrame:
    """id, columns of the cells (id, x, y) that lines reach.

    Lines are sampled every max(edge / 2, 5); a cell aggregates all samples within margin + 2 * edge (default: the
    maximum), so long lines weigh more in sums and means. Cells without one take the nearest sample within ``fallback``
    times the edge; None leaves them out.
    """
    plans = strategies if isinstance(strategies, dict) else {c: strategies or Max() for c in columns}
    samples = densify(lines.select("line", *columns), max(edge / 2, 5.0))
    places, groups = _alike(centres)
    reached = cut(within(samples, places, margin + 2 * edge).groupBy(F.col("centre").alias("group")).agg(F.struct(*(plans[c].up(c).alias(c) for c in columns)).alias("v")))
    hits = groups.join(dealt(reached, is_few(reached)), "group").select("id", "v.*")
    if not fallback:
        return hits
    lacking = centres.join(hits.select("id"), "id", "left_anti").select("id", *(F.col(c).alias(b) for b, c in (("minx", "x"), ("miny", "y"), ("maxx", "x"), ("maxy", "y"))))
    # samples at one place count as the one with the smallest values, so that the choice is the same on each run
    given = cut(samples.groupBy("x", "y").agg(F.min(F.struct(*columns)).alias("v"))).withColumn("id", F.struct("x", "y"))
    spots = given.select("id", "v", *(F.col(c).alias(b) for b, c in (("minx", "x"), ("miny", "y"), ("maxx", "x"), ("maxy", "y"))))
    near = nr.nearest(lacking, spots, fallback * edge).filter(F.col("distance") <= fallback * edge)
    return hits.unionByName(near.join(spots.select(F.col("id").alias("dst_id"), "v"), "dst_id").select(F.col("src_id").alias("id"), *(F.col("v")[c].alias(c) for c in columns)))


def street_cell_mapping(lines: DataFrame, centres: DataFrame, edge: float, margin: float = 10.0) -> DataFrame:
    """Distinct (src_id, dst_id) of lines and the cells that a sample of theirs is near."""
    places, groups = _alike(centres)
    found = within(densify(lines.select("id", "line"), max(edge / 2, 5.0)), places, margin + 2 * edge)
    pairs = found.select(F.col("id").alias("src_id"), F.col("centre").alias("group")).distinct()
    return pairs.join(groups.withColumnRenamed("id", "dst_id"), "group").select("src_id", "dst_id")


def compose_street_polygon(streets: DataFrame, cell_polygons: DataFrame) -> DataFrame:
    """Distinct (line, polygon) over the cells that both mappings share."""
    return mp.compose(streets, cell_polygons)


def edges_to_level(lines: DataFrame, layer: DataFrame, size: float, columns: list[str], strategies: Strategy | dict[str, Strategy] | None = None) -> DataFrame:
    """The layer with the lines' columns: one level that the lines are brought into, by their length in each polygon where
    a strategy is geoweighted; else each line goes to one of the polygons that it meets, the one with the smallest id."""
    levels = Levels(size)
    levels.add_level("target", layer.select("id", *(c for c in (*mp.BOX, *GEOMETRIES, "dim") if c in layer.columns)))
    levels.add_vector(lines, "target", strategies or Mean(), columns, measure="length", upward=True, fill_null=None)
    return levels.level("target", columns)
