"""Queries on lines and polygons of any form, and their closed-form SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import projections as pr
from .functions import strategies as st
from .levels import Levels, measured
from .operators import buffers as bf
from .operators import lines as ln
from .operators import mapping as mp
from .operators import nearest as nr
from .operators import polygons as pg
from .operators import shapes as sh
from .operators import union as un
from .queries import _HOLES, SIDE, _holes, _r, query
from .sources import layers as ly
from .sources import vector_tiles as vt
from .sources import wkb

# --- level graphs -----------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey AS id, round(sum(bal), 7) AS bal, round(sum(w), 7) AS w FROM cen JOIN cus ON src_id = id JOIN nation ON dst_id = n_nationkey GROUP BY n_regionkey")
def q_strategy_travels(spark: SparkSession, d: str) -> DataFrame:
    """One strategy given with the finest level carries all its columns to the top."""
    graph = Levels(SIDE)
    graph.add_level("region", ly.regions(spark, d))
    graph.add_level("nation", ly.nations(spark, d), parent="region")
    graph.add_level("customer", ly.customers(spark, d), strategies=st.Sum(), parent="nation")
    return graph.level("region", ["bal", "w"]).select("id", _r("bal"), _r("w"))


@query(", g AS (SELECT dst_id AS id, sum(price * weight) AS price FROM ovl JOIN par ON src_id = id GROUP BY dst_id) SELECT nat.id, round(coalesce(price, 0), 7) AS price FROM nat LEFT JOIN g USING (id)")
def q_vector_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one id are rows of their own."""
    graph = Levels(SIDE)
    graph.add_level("nation", ly.nations(spark, d))
    graph.add_vector(ly.parts(spark, d).withColumn("id", F.lit(1)), "nation", st.Sum(geoweighted=True), "price")
    return graph.level("nation", "price").select("id", _r("price"))


# --- lines ------------------------------------------------------------------------------------------------------------

_BEND = """, cut AS (SELECT p.id AS src_id, n.id AS dst_id, price, least(4, n.x0 + 8 - p.x0, n.y0 + 8 - p.y0) - greatest(0, n.x0 - p.x0, n.y0 - p.y0) AS t,
 CASE WHEN p.x0 + 4 BETWEEN n.x0 AND n.x0 + 8 THEN least(p.y0 + 4, n.y0 + 8) - greatest(p.y0, n.y0) ELSE -1 END AS v FROM par p, nat n),
bend AS (SELECT src_id, dst_id, price, (greatest(t, 0) * sqrt(2.0) + greatest(v, 0)) / (4 * sqrt(2.0) + 4) AS weight FROM cut WHERE t >= 0 OR v >= 0)"""


@query(_BEND + " SELECT src_id, dst_id, round(weight, 7) AS weight FROM bend")
def q_line_shares(spark: SparkSession, d: str) -> DataFrame:
    return mp.map_exact(ly.bends(spark, d), ly.nations(spark, d), SIDE).select("src_id", "dst_id", _r("weight"))


@query(_BEND + " SELECT src_id, min(dst_id) AS dst_id FROM bend GROUP BY src_id")
def q_line_first(spark: SparkSession, d: str) -> DataFrame:
    """Lines keep their form in the centroid mode: each goes to the first polygon that it meets."""
    return mp.map_centroid(ly.bends(spark, d), ly.nations(spark, d), SIDE).select("src_id", "dst_id")


@query(_BEND + ", g AS (SELECT dst_id AS id, sum(price * weight) / sum(weight) AS price FROM bend GROUP BY dst_id HAVING sum(weight) > 0) SELECT nat.id, round(price, 7) AS price FROM nat LEFT JOIN g USING (id)")
def q_edges_to_level(spark: SparkSession, d: str) -> DataFrame:
    return ln.edges_to_level(ly.bends(spark, d), ly.nations(spark, d), SIDE, ["price"], st.Mean(geoweighted=True)).select("id", _r("price"))


# --- polygons with holes and several parts ----------------------------------------------------------------------------

_OVER = "greatest(0, least(p.x0 + {b}, n.x0 + 8) - greatest(p.x0 + {a}, n.x0)) * greatest(0, least(p.y0 + {b}, n.y0 + 8) - greatest(p.y0 + {a}, n.y0))"
_CLOSE = "FROM par p JOIN nat n ON p.x0 <= n.x0 + 8 AND n.x0 <= p.x0 + 4 AND p.y0 <= n.y0 + 8 AND n.y0 <= p.y0 + 4"


@query(f" SELECT p.id AS src_id, n.id AS dst_id, round(({_OVER.format(a=0, b=4)} - {_OVER.format(a=1, b=3)}) / 12.0, 7) AS weight {_CLOSE}")
def q_hole_exact(spark: SparkSession, d: str) -> DataFrame:
    return mp.map_exact(ly.frames(spark, d), ly.nations(spark, d), SIDE).select("src_id", "dst_id", _r("weight"))


@query(" SELECT p.id AS src_id, min(n.id) AS dst_id, CAST(2.0 AS DOUBLE) AS area, CAST(8.0 AS DOUBLE) AS length, any_value(p.x0 + 2) AS cx, any_value(p.y0 + 2) AS cy FROM par p JOIN nat n ON p.x0 + 2 BETWEEN n.x0 AND n.x0 + 8 AND p.y0 + 2 BETWEEN n.y0 AND n.y0 + 8 GROUP BY p.id")
def q_multi_centroid(spark: SparkSession, d: str) -> DataFrame:
    layer = ly.islands(spark, d)
    found = measured(layer).select(F.col("id").alias("src_id"), _r("area"), _r("length"), _r("cx"), _r("cy"))
    return mp.map_centroid(layer, ly.nations(spark, d), SIDE).drop("weight").join(found, "src_id")


@query(f" SELECT p.id AS src_id, n.id AS dst_id, round(1.0 / count(*) OVER (PARTITION BY p.id), 7) AS weight {_CLOSE} WHERE p.x0 >= n.x0 AND p.x0 + 4 <= n.x0 + 8 AND p.y0 >= n.y0 AND p.y0 + 4 <= n.y0 + 8")
def q_multi_touches(spark: SparkSession, d: str) -> DataFrame:
    return mp.map_touches(ly.islands(spark, d), ly.nations(spark, d), SIDE).select("src_id", "dst_id", _r("weight"))


@query(" SELECT p.id AS src_id, n.id AS dst_id FROM par p JOIN nat n ON p.x0 <= n.x0 + 8 AND p.y0 <= n.y0 + 8 AND p.x0 + p.y0 + 4 >= n.x0 + n.y0 + 8")
def q_ring_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Rings whose boxes overlap but which stay apart are no pair; those with a corner or side in common are."""
    return mp.map_intersects(ly.triangles(spark, d), ly.wedges(spark, d), SIDE).select("src_id", "dst_id")


# --- union, systems, measures -----------------------------------------------------------------------------------------


@query(" SELECT n_regionkey AS id, CAST(count(*) * 64 AS DOUBLE) AS area, CAST(16.0 + count(*) * 16 AS DOUBLE) AS length, CAST(1 AS BIGINT) AS parts, CAST(4 AS BIGINT) AS corners FROM nation GROUP BY n_regionkey")
def q_dissolve(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region stand on each other, so each region's union is one box without inner sides."""
    nations = ly.nations(spark, d).join(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")), "id")
    whole = measured(un.dissolved(nations, "region", SIDE))
    straight = F.filter(F.col("shape")[0], lambda p, i: ~p["y"].isin(*(8.0 * k for k in range(1, 5))))
    return whole.select("id", _r("area"), _r("length"), F.size("shape").cast("long").alias("parts"), F.size(F.array_distinct(straight)).cast("long").alias("corners"))


@query(" SELECT id, CAST(16000000.0 AS DOUBLE) AS area, CAST(16000.0 AS DOUBLE) AS length FROM par")
def q_level_metres(spark: SparkSession, d: str) -> DataFrame:
    """Boxes given in metres of a UTM zone, kept in degrees and measured in metres again."""
    graph = Levels(0.1, crs="EPSG:4326")
    metres = {c: F.col(c) * 1000 + (480_000 if c.endswith("x") else 5_300_000) for c in mp.BOX}
    graph.add_level("part", ly.parts(spark, d).drop("price").withColumns(metres), crs="EPSG:32631")
    return graph.geometry["part"].select("id", F.round("area", 1).alias("area"), F.round("length", 3).alias("length"))


@query(_HOLES + ", far AS (SELECT id, w FROM pick JOIN (SELECT id AS e, x AS ex, y AS ey FROM cus) a ON pick.id = e JOIN (SELECT id AS f, x AS fx, y AS fy FROM cus) b ON donor = f WHERE rank = 1 AND sqrt((ex - fx) ** 2 + (ey - fy) ** 2) > 0.53) SELECT coalesce(sum(w), 0.0) AS excluded FROM far")
def q_relocate_metres(spark: SparkSession, d: str) -> DataFrame:
    """Distances between places in degrees are metres: the customers' map at a kilometre a unit, within 530 metres."""
    metres = {c: F.col(c) * 1000 + (480_000 if c.endswith("x") else 5_300_000) for c in mp.BOX}
    layer = pr.reprojected(_holes(spark, d).withColumns(metres), "EPSG:32631", "EPSG:4326")
    return nr.relocate_weight(layer, "bal", "w", 1000.0, most=530.0, crs="EPSG:4326")[1]


@query(f" SELECT n.id, round(sum(price * ({_OVER.format(a=0, b=4)} - {_OVER.format(a=1, b=3)}) / 12.0), 6) AS price {_CLOSE} GROUP BY n.id")
def q_wkb_level(spark: SparkSession, d: str) -> DataFrame:
    """Polygons with holes from a binary column."""
    graph = Levels(SIDE)
    graph.add_level("nation", wkb.encoded(ly.nations(spark, d)).select("id", "geometry"))
    graph.add_level("part", wkb.encoded(ly.frames(spark, d)).select("id", "price", "geometry"), strategies=st.Sum(geoweighted=True), child=None, parent="nation")
    return graph.level("nation", "price").select("id", F.round("price", 6).alias("price"))


@query(" SELECT id, x0 + 0.5 AS px, y0 + 2.0 AS py FROM par")
def q_representative(spark: SparkSession, d: str) -> DataFrame:
    """A point inside each frame, beside its hole: the middle of the first of the longest upright stretches."""
    return sh.shaped(ly.frames(spark, d)).select("id", sh.measures("shape", "dim").alias("m")).select("id", _r("m.px").alias("px"), _r("m.py").alias("py"))


@query(" SELECT n_nationkey AS id, round(64 + 4 * 8 * 1.5 + 8 * 1.5 * 1.5 * sin(pi() / 8), 6) AS area, round(32 + 32 * 1.5 * sin(pi() / 16), 6) AS length FROM nation")
def q_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Boxes widened by 1.5 with round corners of four sides: area and length in closed form."""
    return measured(bf.buffered(ly.nations(spark, d), 1.5, resolution=4)).select("id", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"))


# --- tiles ------------------------------------------------------------------------------------------------------------

_WY = "((1 - asinh(tan(radians({y}))) / pi()) / 2 * 64)"


@query(f", w AS (SELECT id, (x0 + 180) / 360 * 64 AS xa, (x0 + 184) / 360 * 64 AS xb, {_WY.format(y='(y0 + 4)')} AS ya, {_WY.format(y='y0')} AS yb FROM par), t AS (SELECT *, unnest(range(CAST(floor(xa) AS BIGINT), CAST(floor(xb) AS BIGINT) + 1)) AS x FROM w), u AS (SELECT *, unnest(range(CAST(floor(ya) AS BIGINT), CAST(floor(yb) AS BIGINT) + 1)) AS y FROM t), c AS (SELECT id, x, y, least(xb, x + 1) - greatest(xa, x) AS w, least(yb, y + 1) - greatest(ya, y) AS h FROM u) SELECT id, CAST(6 AS INTEGER) AS z, x, y, round(w * h, 7) AS area FROM c WHERE round(w * 4096) >= 2 AND round(h * 4096) >= 2")
def q_tile_clip(spark: SparkSession, d: str) -> DataFrame:
    """The parts' boxes cut by the tiles of zoom 6: the area of each piece in tiles."""
    found = vt.tile_features(ly.parts(spark, d), 6, buffer=0.0).withColumn("m", sh.measures("part", F.lit(2)))
    sides = [F.array_max(pg.each(F.col("part")[0], c)) - F.array_min(pg.each(F.col("part")[0], c)) for c in "xy"]
    kept = found.filter((F.round(sides[0] * 4096) >= 2) & (F.round(sides[1] * 4096) >= 2))
    return kept.select("id", "z", "x", "y", _r("m.area").alias("area"))
