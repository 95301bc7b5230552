"""Queries on level graphs, rasters, cells, lines, polygons and tiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import measures as ms
from .functions import strategies as st
from .levels import Levels
from .operators import cells as cl
from .operators import lines as ln
from .operators import mapping as mp
from .operators import nearest as nr
from .operators import polygons as pg
from .operators import raster as ra
from .queries import _HOLES, SIDE, _balances, _holes, _r, query
from .scratch import shared_folder
from .sources import kept
from .sources import layers as ly
from .sources import tiles as tl

GRID = ra.Affine(1.0, 0.0, 0.0, 0.0, -1.0, 40.0)
_REG = ", reg AS (SELECT r_regionkey AS id, r_regionkey * 8.0 AS x0 FROM region), nr AS (SELECT n_nationkey AS id, n_regionkey AS reg FROM nation)"


# --- level graphs -----------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, d: str, regions=None, nations=None, customers: bool = True) -> Levels:
    """Customers below nations below regions; ``regions`` and ``nations`` may bring columns of their own."""
    graph = Levels(SIDE)
    graph.set_strategy("bal", st.Sum(), propagate=False)
    graph.add_level("region", ly.regions(spark, d) if regions is None else regions)
    graph.add_level("nation", ly.nations(spark, d) if nations is None else nations, parent="region")
    if customers:
        graph.add_level("customer", ly.customers(spark, d).drop("w"), parent="nation")
    return graph


@query("SELECT n_regionkey AS id, round(sum(bal), 7) AS total FROM cen JOIN cus ON src_id = id JOIN nation ON dst_id = n_nationkey GROUP BY n_regionkey")
def q_two_hop_propagate(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).level("region", "bal").select("id", F.round("bal", 7).alias("total"))


@query(_REG + ", own AS (SELECT dst_id AS id, round(sum(bal), 7) AS bal FROM cen JOIN cus ON src_id = id GROUP BY dst_id) SELECT id, bal, CAST(1000.0 AS DOUBLE) AS region_bal FROM own")
def q_child_wins(spark: SparkSession, d: str) -> DataFrame:
    graph = _graph(spark, d, regions=ly.regions(spark, d).withColumn("bal", F.lit(1000.0)))
    up = mp.map_centroid(graph.geometry["nation"], graph.geometry["region"], SIDE).select(F.col("src_id").alias("id"), F.col("dst_id").alias("_r"))
    regions = graph.tables["region"].select(F.col("id").alias("_r"), F.col("bal").alias("region_bal"))
    return graph.level("nation", "bal").select("id", _r("bal")).filter("bal is not null").join(up, "id").join(regions, "_r").select("id", "bal", "region_bal")


_NATIVE = "CASE WHEN n.id % 3 > 0 THEN CAST(n.id * 10 AS DOUBLE) END"


def _gaps(spark: SparkSession, d: str) -> Levels:
    regions = ly.regions(spark, d).withColumn("bal", F.col("id") * 1000.0 + 500)
    nations = ly.nations(spark, d).withColumn("bal", F.when(F.col("id") % 3 > 0, F.col("id") * 10.0))
    return _graph(spark, d, regions, nations, customers=False)


@query(_REG + f", k AS (SELECT reg, count(*) AS n FROM nr GROUP BY reg) SELECT n.id, round(coalesce({_NATIVE}, (n.reg * 1000.0 + 500) / k.n), 7) AS bal FROM nr n JOIN k USING (reg)")
def q_null_backfill(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).level("nation", "bal").select("id", _r("bal"))


@query(_REG + " SELECT id, reg * 1000.0 + 500 AS rate FROM nr")
def q_down_mean_broadcast(spark: SparkSession, d: str) -> DataFrame:
    graph = Levels(SIDE)
    graph.add_level("region", ly.regions(spark, d).withColumn("rate", F.col("id") * 1000.0 + 500), strategies={"rate": st.Mean()})
    graph.add_level("nation", ly.nations(spark, d), parent="region")
    return graph.level("nation", "rate").select("id", "rate")


@query(", t AS (SELECT dst_id, sum(bal) AS v FROM cen JOIN cus ON src_id = id GROUP BY dst_id), s AS (SELECT src_id, v * weight / sum(weight) OVER (PARTITION BY dst_id) AS part FROM ovl JOIN t USING (dst_id)), g AS (SELECT src_id AS id, coalesce(sum(part), 0) AS bal FROM s GROUP BY src_id) SELECT id, round(bal * (SELECT sum(v) FROM t) / (SELECT sum(bal) FROM g), 4) AS bal FROM g")
def q_down_sum_area(spark: SparkSession, d: str) -> DataFrame:
    nations, fine = _balances(spark, d), ly.parts(spark, d)
    mapping = mp.id_mapping(fine, ly.nations(spark, d), SIDE, geoweighted=True)
    plan = {"bal": st.Sum(geoweighted=True)}
    return st.rescale(st.downscale(mapping, nations, plan), nations, ["bal"]).select("id", F.round("bal", 4).alias("bal"))


@query(", m AS (SELECT c.id AS src_id, min(p.id) AS dst_id FROM cus c JOIN par p ON c.x BETWEEN p.x0 AND p.x0 + 4 AND c.y BETWEEN p.y0 AND p.y0 + 4 GROUP BY c.id), k AS (SELECT dst_id, count(*) AS n FROM m GROUP BY dst_id), g AS (SELECT src_id AS id, price / n AS price FROM m JOIN k USING (dst_id) JOIN par ON dst_id = id) SELECT id, round(price * (SELECT sum(price) FROM par) / (SELECT sum(price) FROM g), 4) AS price FROM g")
def q_rescale(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no customer falls to hand their prices to all that were reached."""
    coarse = ly.parts(spark, d)
    mapping = mp.map_centroid(ly.customers(spark, d), coarse, 4.0)
    return st.sum_down(mapping, coarse, "price").select("id", F.round("price", 4).alias("price"))


@query(", t AS (SELECT dst_id, sum(bal) AS v FROM cen JOIN cus ON src_id = id GROUP BY dst_id), nc AS (SELECT id, x0 + 4 AS x, y0 + 4 AS y FROM nat), near AS (SELECT p.id, n.id AS dst_id, pow(sqrt((p.x0 + 2 - n.x) ** 2 + (p.y0 + 2 - n.y) ** 2) + 1e-9, -2) AS w, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x0 + 2 - n.x) ** 2 + (p.y0 + 2 - n.y) ** 2), n.id) AS rank FROM par p CROSS JOIN nc n), b AS (SELECT id, sum(v / 64.0 * w) / sum(w) * 16.0 AS bal FROM near JOIN t USING (dst_id) WHERE rank <= 3 GROUP BY id) SELECT id, round(bal * (SELECT sum(v) FROM t) / (SELECT sum(bal) FROM b), 5) AS bal FROM b")
def q_smooth_density(spark: SparkSession, d: str) -> DataFrame:
    graph = Levels(SIDE)
    blend = st.Composite(st.Sum(), st.SmoothMean(k=3, density=True))
    graph.add_level("nation", ly.nations(spark, d).join(_balances_raw(spark, d), "id", "left"), strategies={"bal": blend})
    graph.add_level("part", ly.parts(spark, d).drop("price"), parent="nation")
    return graph.level("part", "bal").select("id", F.round("bal", 5).alias("bal"))


def _balances_raw(spark: SparkSession, d: str) -> DataFrame:
    return st.upscale(mp.map_centroid(ly.customers(spark, d), ly.nations(spark, d), SIDE), ly.customers(spark, d), {"bal": st.sum_up("bal")})


@query(", g AS (SELECT dst_id AS id, sum(price * weight) AS price FROM ovl JOIN par ON src_id = id GROUP BY dst_id) SELECT nat.id, round(coalesce(price, 0), 7) AS price FROM nat LEFT JOIN g USING (id)")
def q_vector_inject(spark: SparkSession, d: str) -> DataFrame:
    graph = Levels(SIDE)
    graph.add_level("nation", ly.nations(spark, d))
    graph.add_vector(ly.parts(spark, d), "nation", st.Sum(geoweighted=True), "price")
    return graph.level("nation", "price").select("id", _r("price"))


@query(_REG + ", k AS (SELECT reg, count(*) AS n FROM nr GROUP BY reg), g AS (SELECT dst_id AS id, sum(price * weight) AS price FROM ovl JOIN par ON src_id = id GROUP BY dst_id) SELECT nr.id, round(coalesce(price, 0), 7) AS price, round((reg * 1000.0 + 500) / k.n, 7) AS grant FROM nr JOIN k USING (reg) LEFT JOIN g USING (id)")
def q_median_direction(spark: SparkSession, d: str) -> DataFrame:
    """By the medians of their areas parts are finer than nations and regions are coarser: one goes up, the other down."""
    graph = Levels(SIDE)
    graph.add_level("nation", ly.nations(spark, d))
    graph.add_vector(ly.parts(spark, d), "nation", st.Sum(geoweighted=True), "price")
    graph.add_vector(ly.regions(spark, d).withColumn("grant", F.col("id") * 1000.0 + 500), "nation", st.Sum(), "grant")
    return graph.level("nation", ["price", "grant"]).select("id", _r("price"), _r("grant"))


@query(_HOLES + ", seg AS (SELECT c_custkey AS id, c_mktsegment AS segment FROM customer) SELECT segment, round(sum(bal * w) / sum(CASE WHEN bal IS NOT NULL THEN w END), 7) AS bal FROM h JOIN seg USING (id) GROUP BY segment")
def q_weighted_mean_groups(spark: SparkSession, d: str) -> DataFrame:
    segments = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return nr.group_means(_holes(spark, d).join(segments, "id"), "bal", "w", ["segment"]).select("segment", _r("bal"))


@query(_HOLES + ", far AS (SELECT id, w FROM pick JOIN (SELECT id AS e, x AS ex, y AS ey FROM cus) a ON pick.id = e JOIN (SELECT id AS f, x AS fx, y AS fy FROM cus) b ON donor = f WHERE rank = 1 AND sqrt((ex - fx) ** 2 + (ey - fy) ** 2) > 0.5) SELECT coalesce(sum(w), 0.0) AS excluded FROM far")
def q_relocate_excluded(spark: SparkSession, d: str) -> DataFrame:
    return nr.relocate_weight(_holes(spark, d), "bal", "w", 1.0, most=0.5)[1]


@query(" SELECT DISTINCT src_id, n_regionkey AS dst_id FROM cen JOIN nation ON dst_id = n_nationkey")
def q_compose_mapping(spark: SparkSession, d: str) -> DataFrame:
    nations = ly.nations(spark, d)
    return mp.compose(mp.map_centroid(ly.customers(spark, d), nations, SIDE), mp.map_centroid(nations, ly.regions(spark, d), SIDE))


@query(" SELECT src_id, dst_id, 1.0::DOUBLE AS weight FROM cen")
def q_kept_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Built and written, then found under the geometry of both layers."""
    folder = f"{shared_folder(spark)}/mappings"
    customers, nations = ly.customers(spark, d), ly.nations(spark, d)
    kept.level_mapping(folder, customers, nations, SIDE, "customers_nations", force=True)
    return kept.level_mapping(folder, customers, nations, SIDE, "customers_nations").select("src_id", "dst_id", F.col("weight").cast("double").alias("weight"))


# --- lines ------------------------------------------------------------------------------------------------------------

_SEG = ", seg AS (SELECT o_orderkey AS id, ((o_custkey * 37) % 320) / 8.0 AS xa, (((o_custkey + 1) * 37) % 320) / 8.0 AS xb, ((o_custkey * 101) % 320) / 8.0 AS y, o_totalprice AS price FROM orders)"


@query(_SEG + " SELECT s.id AS src_id, n.id AS dst_id, round(CASE WHEN xa = xb THEN 1.0 ELSE (least(greatest(xa, xb), n.x0 + 8) - greatest(least(xa, xb), n.x0)) / abs(xb - xa) END, 7) AS weight FROM seg s JOIN nat n ON least(xa, xb) <= n.x0 + 8 AND greatest(xa, xb) >= n.x0 AND y BETWEEN n.y0 AND n.y0 + 8")
def q_length_exact(spark: SparkSession, d: str) -> DataFrame:
    return mp.map_exact(ly.segments(spark, d), ly.nations(spark, d), SIDE).select("src_id", "dst_id", _r("weight"))


@query(_SEG + ", k AS (SELECT *, greatest(1, CAST(ceil(abs(xb - xa) / 2.0) AS INTEGER)) AS n FROM seg) SELECT id, CAST(count(*) AS BIGINT) AS n, round(sum(x), 5) AS sum_x FROM (SELECT id, xa + (xb - xa) * i / n AS x FROM k, LATERAL (SELECT unnest(range(0, n + 1)) AS i)) GROUP BY id")
def q_densify(spark: SparkSession, d: str) -> DataFrame:
    return ln.densify(ly.segments(spark, d), 2.0).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 5).alias("sum_x"))


_SAMPLES = _SEG + ", k AS (SELECT *, greatest(1, CAST(ceil(abs(xb - xa) / 5.0) AS INTEGER)) AS n FROM seg), smp AS (SELECT id, price, y, xa + (xb - xa) * i / n AS x FROM k, LATERAL (SELECT unnest(range(0, n + 1)) AS i)), cc AS (SELECT id, x0 + 2 AS cx, y0 + 2 AS cy FROM par)"


def _cell_centres(spark: SparkSession, d: str) -> DataFrame:
    return ly.parts(spark, d).select("id", (F.col("minx") + 2).alias("x"), (F.col("miny") + 2).alias("y"))


@query(_SAMPLES + " SELECT cc.id, max(price) AS price FROM cc JOIN smp ON sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 0.75 GROUP BY cc.id")
def q_edges_distance(spark: SparkSession, d: str) -> DataFrame:
    return ln.edges_to_cells(ly.segments(spark, d), _cell_centres(spark, d), ["price"], edge=0.25, margin=0.25, fallback=None)


@query(_SAMPLES + ", spot AS (SELECT x, y, min(price) AS price FROM smp GROUP BY x, y), d AS (SELECT cc.id, x, y, price, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM cc JOIN spot ON abs(x - cx) <= 10 AND abs(y - cy) <= 10), hit AS (SELECT cc.id, max(price) AS price FROM cc JOIN smp ON sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 0.02 GROUP BY cc.id), near AS (SELECT id, price FROM d WHERE r <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, x, y) = 1) SELECT id, price, true AS direct FROM hit UNION ALL SELECT id, price, false FROM near WHERE id NOT IN (SELECT id FROM hit)")
def q_edges_fallback(spark: SparkSession, d: str) -> DataFrame:
    lines, centres = ly.segments(spark, d), _cell_centres(spark, d)
    found = ln.edges_to_cells(lines, centres, ["price"], edge=0.01, margin=0.0, fallback=500.0)
    direct = ln.edges_to_cells(lines, centres, ["price"], edge=0.01, margin=0.0, fallback=None).select("id", F.lit(True).alias("direct"))
    return found.join(direct, "id", "left").select("id", "price", F.coalesce("direct", F.lit(False)).alias("direct"))


@query(_SAMPLES + " SELECT DISTINCT smp.id AS src_id, cc.id AS dst_id FROM cc JOIN smp ON sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 0.25")
def q_street_cells(spark: SparkSession, d: str) -> DataFrame:
    return ln.street_cell_mapping(ly.segments(spark, d), _cell_centres(spark, d), edge=0.125, margin=0.0)


# --- rasters ----------------------------------------------------------------------------------------------------------

_PIX = ", pix AS (SELECT l_partkey % 40 AS r, l_suppkey % 40 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_MEET = ", met AS (SELECT r, c, v, p.id, (least(c + 1, p.x0 + 4) - greatest(c, p.x0)) * (least(40 - r, p.y0 + 4) - greatest(39 - r, p.y0)) AS a FROM pix JOIN par p ON c <= p.x0 + 4 AND c + 1 >= p.x0 AND 39 - r <= p.y0 + 4 AND 40 - r >= p.y0), tot AS (SELECT r, c, count(*) AS n, sum(a) AS s FROM met GROUP BY r, c)"


@query(_PIX + ", g AS (SELECT id, sum(v) AS v FROM (SELECT r, c, v, min(n.id) AS id FROM pix JOIN nat n ON c + 0.5 BETWEEN n.x0 AND n.x0 + 8 AND 39.5 - r BETWEEN n.y0 AND n.y0 + 8 GROUP BY ALL) GROUP BY id) SELECT nat.id, round(coalesce(v, 0), 5) AS value FROM nat LEFT JOIN g USING (id)")
def q_raster_points(spark: SparkSession, d: str) -> DataFrame:
    graph = Levels(SIDE)
    graph.add_level("nation", ly.nations(spark, d))
    graph.add_raster(ly.pixels(spark, d), GRID, "value", "nation", st.Sum())
    return graph.level("nation", "value").select("id", F.round("value", 5).alias("value"))


@query(_PIX + _MEET + " SELECT id, round(sum(v * CASE WHEN n = 1 THEN 1.0 ELSE a / s END), 4) AS value FROM met JOIN tot USING (r, c) WHERE n = 1 OR s > 0 GROUP BY id")
def q_raster_polygons(spark: SparkSession, d: str) -> DataFrame:
    return ra.to_polygons(ly.pixels(spark, d), GRID, ly.parts(spark, d), 4.0).select("id", F.round("value", 4).alias("value"))


@query(_PIX + " SELECT round(sum(v), 5) AS total, round(avg(v), 5) AS mean, count(v) AS n, min(v) AS low, max(v) AS high FROM pix")
def q_raster_totals(spark: SparkSession, d: str) -> DataFrame:
    pixels = ly.pixels(spark, d)
    totals = ra.valid_totals(pixels).select(F.round("total", 5).alias("total"), F.round("mean", 5).alias("mean"), "n")
    return totals.crossJoin(F.broadcast(ra.density_bounds(pixels, GRID)))


def _sql_x(x: str, z: int) -> str:
    return f"CAST(floor(({x} + 180) / 360 * {2**z}) AS BIGINT)"


def _sql_y(y: str, z: int) -> str:
    return f"CAST(floor((1 - ln(tan(radians({y})) + 1 / cos(radians({y}))) / pi()) / 2 * {2**z}) AS BIGINT)"


def _sql_cell(x: str, y: str, z: int) -> str:
    return f"(CAST({z} AS BIGINT) << 56) + ({_sql_x(x, z)} << 28) + {_sql_y(y, z)}"


def _sql_up(cell: str, z: int, to: int) -> str:
    """The ancestor of a cell of level z."""
    return f"(CAST({to} AS BIGINT) << 56) + (((({cell} >> 28) & 268435455) >> {z - to}) << 28) + (({cell} & 268435455) >> {z - to})"


_LNG = "(gx + 0.5) / 512.0 * 360 - 180"
_LAT = "degrees(atan(sinh(pi() * (1 - 2 * (gy + 0.5) / 512.0))))"
_CELLS = f", gr AS (SELECT gx, gy, (CAST(9 AS BIGINT) << 56) + (CAST(gx AS BIGINT) << 28) + gy AS cell, {_LNG} AS lng, {_LAT} AS lat FROM range(0, 512) a(gx), range(0, 512) b(gy))"


@query(_PIX + _CELLS + " SELECT cell, v AS value FROM gr JOIN pix ON floor(lng) = c AND floor(40 - lat) = r WHERE lng BETWEEN 0 AND 40 AND lat BETWEEN 0 AND 40")
def q_raster_cell_map(spark: SparkSession, d: str) -> DataFrame:
    extent = ly.pixels(spark, d).agg(F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), F.lit(40.0).alias("maxx"), F.lit(40.0).alias("maxy"))
    return ra.apply_cell_pixels(ra.cell_pixels(cl.cover(extent, 9), GRID, 40, 40), ly.pixels(spark, d))


@query(_PIX + _CELLS + ", s AS (SELECT cell, v FROM gr JOIN pix ON floor(lng) = c AND floor(40 - lat) = r WHERE lng BETWEEN 0 AND 40 AND lat BETWEEN 0 AND 40) SELECT cell, round(v * (SELECT avg(v) FROM pix) / (SELECT avg(v) FROM s), 5) AS value FROM s")
def q_raster_cells_by_centre(spark: SparkSession, d: str) -> DataFrame:
    return ra.to_cells_auto(ly.pixels(spark, d), GRID, 40, 40, 9, is_count=False).select("cell", F.round("value", 5).alias("value"))


_AREA = "pow(6371000.0, 2) * radians(360.0 / 32) * (sin(atan(sinh(pi() * (1 - 2 * (cell & 268435455) / 32.0)))) - sin(atan(sinh(pi() * (1 - 2 * ((cell & 268435455) + 1) / 32.0)))))"


@query(_PIX + f", p AS (SELECT v, {_sql_cell('(c + 0.5)', '(39.5 - r)', 5)} AS cell, abs(radians(1.0) * 6371000.0 * cos(radians(39.5 - r)) * radians(-1.0) * 6371000.0) AS area FROM pix), k AS (SELECT cell, avg(v / area) * {_AREA} AS value FROM p GROUP BY cell) SELECT cell, round(value * (SELECT sum(v) FROM p) / (SELECT sum(value) FROM k), 4) AS value FROM k")
def q_points_to_cells_count(spark: SparkSession, d: str) -> DataFrame:
    return ra.to_cells_nearest(ly.pixels(spark, d), GRID, 5).select("cell", F.round("value", 4).alias("value"))


_PLACED = f", pl AS (SELECT *, {_sql_cell('x', 'y', 9)} AS cell FROM cus)"


@query(_PLACED + ", k AS (SELECT cell, avg(bal) AS value FROM pl GROUP BY cell) SELECT cell, round(value * (SELECT avg(bal) FROM pl) / (SELECT avg(value) FROM k), 5) AS value FROM k")
def q_points_to_cells_rate(spark: SparkSession, d: str) -> DataFrame:
    points = ly.customers(spark, d).select(F.col("minx").alias("lng"), F.col("miny").alias("lat"), F.col("bal").alias("value"))
    return ra.points_to_cells(points, 9, is_count=False).select("cell", F.round("value", 5).alias("value"))


# --- cells ------------------------------------------------------------------------------------------------------------


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return ly.customers(spark, d).withColumn("cell", cl.cell_of(F.col("minx"), F.col("miny"), 9))


@query(_PLACED + f" SELECT {_sql_up('cell', 9, 6)} AS cell, round(sum(bal), 5) AS bal FROM pl GROUP BY 1")
def q_cell_rollup(spark: SparkSession, d: str) -> DataFrame:
    return cl.roll_up(_placed(spark, d), 6, ["bal"]).select("cell", F.round("bal", 5).alias("bal"))


@query(_PLACED + f" SELECT id, cell, {_sql_up('cell', 9, 5)} AS tile FROM pl")
def q_cell_partition(spark: SparkSession, d: str) -> DataFrame:
    return cl.partition_by_ancestor(_placed(spark, d), 5).select("id", "cell", "tile")


_UPS = ", ".join(f"{_sql_up('cell', 9, z)} AS a{z}" for z in range(4, 10))


@query(_PLACED + f", u AS (SELECT id, {_UPS} FROM pl), n AS (SELECT id, " + ", ".join(f"a{z}, count(*) OVER (PARTITION BY a{z}) AS n{z}" for z in range(4, 10)) + " FROM u) SELECT id, CASE " + " ".join(f"WHEN n{z} <= 100 THEN 'res{z}_' || lower(to_hex(a{z}))" for z in range(4, 9)) + " ELSE 'res9_' || lower(to_hex(a9)) END AS chunk FROM n")
def q_chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    return cl.chunk_keys(_placed(spark, d), most=100).select("id", "chunk")


@query(_CELLS + " SELECT DISTINCT cell FROM gr JOIN par p ON lng BETWEEN p.x0 AND p.x0 + 4 AND lat BETWEEN p.y0 AND p.y0 + 4")
def q_cell_cover(spark: SparkSession, d: str) -> DataFrame:
    return cl.cover(ly.parts(spark, d), 9)


@query(_PLACED + ", k AS (SELECT DISTINCT cell FROM pl), s AS (SELECT unnest([-1, 0, 1]) AS d) SELECT cell, cell + CAST(a.d AS BIGINT) * 268435456 + b.d AS neighbour FROM k, s a, s b WHERE a.d <> 0 OR b.d <> 0")
def q_cell_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("cell").distinct().select("cell", F.explode(cl.ring(F.col("cell"))).alias("neighbour"))


# --- polygons ---------------------------------------------------------------------------------------------------------


@query(" SELECT id, CAST(8.0 AS DOUBLE) AS area, round(x0 + 4.0 / 3, 7) AS cx, round(y0 + 4.0 / 3, 7) AS cy, round(8 + sqrt(32.0), 7) AS perimeter FROM par")
def q_polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    ring = F.col("ring")
    cx, cy = pg.centroid(ring)
    return ly.triangles(spark, d).select("id", pg.area(ring).alias("area"), F.round(cx, 7).alias("cx"), F.round(cy, 7).alias("cy"), F.round(pg.perimeter(ring), 7).alias("perimeter"))


_CORNER = "({p} * {q} - pow(greatest(0, {p} + {q} - 4), 2) / 2)"
_WEDGE = f", clip AS (SELECT p.id AS src_id, n.id AS dst_id, greatest(n.x0 - p.x0, 0) AS a, least(n.x0 + 8 - p.x0, 4) AS b, greatest(n.y0 - p.y0, 0) AS c, least(n.y0 + 8 - p.y0, 4) AS d FROM par p JOIN nat n ON p.x0 <= n.x0 + 8 AND n.x0 <= p.x0 + 4 AND p.y0 <= n.y0 + 8 AND n.y0 <= p.y0 + 4), wedge AS (SELECT src_id, dst_id, {_CORNER.format(p='b', q='d')} - {_CORNER.format(p='a', q='d')} - {_CORNER.format(p='b', q='c')} + {_CORNER.format(p='a', q='c')} AS area FROM clip)"


@query(_WEDGE + " SELECT src_id, dst_id, round(area / 8.0, 6) AS weight FROM wedge JOIN clip USING (src_id, dst_id) WHERE a + c <= 4")
def q_polygon_exact(spark: SparkSession, d: str) -> DataFrame:
    found = mp.map_exact(ly.triangles(spark, d), ly.nations(spark, d), SIDE)
    return found.select("src_id", "dst_id", F.round("weight", 6).alias("weight"))


@query(" SELECT c.id AS src_id, min(p.id) AS dst_id FROM cus c JOIN par p ON c.x >= p.x0 AND c.y >= p.y0 AND c.x - p.x0 + c.y - p.y0 <= 4 GROUP BY c.id")
def q_polygon_centroid(spark: SparkSession, d: str) -> DataFrame:
    return mp.map_centroid(ly.customers(spark, d), ly.triangles(spark, d), 4.0).select("src_id", "dst_id")


# --- tiles ------------------------------------------------------------------------------------------------------------


@query(f" SELECT id, {_sql_x('x', 12)} AS x, {_sql_y('y', 12)} AS y FROM cus")
def q_tile_address(spark: SparkSession, d: str) -> DataFrame:
    return ly.customers(spark, d).select("id", cl.tile_x(F.col("minx"), 12).alias("x"), cl.tile_y(F.col("miny"), 12).alias("y"))


@query(f", t AS (SELECT id, {_sql_x('x0', 6)} AS xa, {_sql_x('(x0 + 4)', 6)} AS xb, {_sql_y('(y0 + 4)', 6)} AS ya, {_sql_y('y0', 6)} AS yb FROM par) SELECT id, CAST(6 AS INTEGER) AS z, x, unnest(range(ya, yb + 1)) AS y FROM (SELECT *, unnest(range(xa, xb + 1)) AS x FROM t)")
def q_feature_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tl.feature_tiles(ly.parts(spark, d), 6, buffer=0.0).select("id", "z", "x", "y")


@query(" SELECT min(price) AS low, max(price) AS high FROM par")
def q_color_domain(spark: SparkSession, d: str) -> DataFrame:
    return tl.domain(ly.parts(spark, d), "price")


@query(", v AS (SELECT DISTINCT c_mktsegment AS value FROM customer) SELECT value, ['red', 'green', 'blue'][((row_number() OVER (ORDER BY value) - 1) % 3) + 1] AS colour FROM v")
def q_categories(spark: SparkSession, d: str) -> DataFrame:
    return tl.categories(spark.read.parquet(f"{d}/customer.parquet"), "c_mktsegment", ["red", "green", "blue"])


@query(", m AS (SELECT log10((SELECT median(8.0 * 40) FROM region)) AS a, log10((SELECT median(64.0) FROM nation)) AS b, log10((SELECT median(16.0) FROM part)) AS c), e AS (SELECT CAST(round_even((a - b) / ((a - c) + (a - b) / 2 + (b - c) / 2) * 25, 0) AS INTEGER) AS u, CAST(round_even((a + (a - b) / 2 - (b + c) / 2) / ((a - c) + (a - b) / 2 + (b - c) / 2) * 25, 0) AS INTEGER) AS v FROM m) SELECT 'region' AS level, 0 AS low, u AS high FROM e UNION ALL SELECT 'nation', u + 1, v FROM e UNION ALL SELECT 'part', v + 1, 25 FROM e")
def q_zoom_ranges(spark: SparkSession, d: str) -> DataFrame:
    graph = Levels(SIDE)
    for name, layer in (("region", ly.regions(spark, d)), ("nation", ly.nations(spark, d)), ("part", ly.parts(spark, d).drop("price"))):
        graph.add_level(name, layer)
    rows = [(n, *r) for n, r in tl.zoom_ranges(tl.median_sizes(graph)).items()]
    return spark.createDataFrame(rows, "level string, low int, high int")


# --- measures ---------------------------------------------------------------------------------------------------------

_TM = "WITH k AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n), q AS (SELECT n, 6378137.0 / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64) AS a, 2 * sqrt(n) / (1 + n) AS e, n / 2 - 2 * pow(n, 2) / 3 + 5 * pow(n, 3) / 16 AS a1, 13 * pow(n, 2) / 48 - 3 * pow(n, 3) / 5 AS a2, 61 * pow(n, 3) / 240 AS a3 FROM k)"


@query(f", t AS (SELECT * FROM ({_TM} SELECT * FROM q) q), p AS (SELECT id, radians(x - 21) AS lam, sinh(atanh(sin(radians(y))) - e * atanh(e * sin(radians(y)))) AS t, t.* FROM cus, t), u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM p) SELECT id, round(500000 + 0.9996 * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 2) AS easting, round(0.9996 * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 2) AS northing FROM u")
def q_utm(spark: SparkSession, d: str) -> DataFrame:
    """All customers in the zone of the middle of their map."""
    east, north = ms.utm(F.col("minx"), F.col("miny"), ms.utm_zone(20.0))
    return ly.customers(spark, d).select("id", F.round(east, 2).alias("easting"), F.round(north, 2).alias("northing"))


@query(" SELECT id, round(pow(6371007.18, 2) * radians(4.0) * (sin(radians(y0 + 4)) - sin(radians(y0))), 2) AS metres FROM par")
def q_geodesic_area(spark: SparkSession, d: str) -> DataFrame:
    return ly.parts(spark, d).select("id", F.round(ms.box_area(*(F.col(c) for c in mp.BOX)), 2).alias("metres"))
