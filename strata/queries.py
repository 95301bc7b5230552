"""Queries over the given tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import strategies as st
from .levels import Levels
from .operators import mapping as mp
from .operators import nearest as nr
from .sources import layers as ly

SIDE = 8.0
QUERIES, ORACLES = {}, {}

_SQL = """WITH nat AS (SELECT n_nationkey AS id, n_regionkey * 8.0 AS x0, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) * 8.0 AS y0 FROM nation),
cus AS (SELECT c_custkey AS id, ((c_custkey * 37) % 320) / 8.0 AS x, ((c_custkey * 101) % 320) / 8.0 AS y, c_acctbal AS bal, CAST(c_custkey % 7 + 1 AS DOUBLE) AS w FROM customer),
par AS (SELECT p_partkey AS id, CAST((p_partkey * 29) % 37 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 36 AS DOUBLE) AS y0, p_retailprice AS price FROM part),
cen AS (SELECT c.id AS src_id, min(n.id) AS dst_id FROM cus c JOIN nat n ON c.x BETWEEN n.x0 AND n.x0 + 8 AND c.y BETWEEN n.y0 AND n.y0 + 8 GROUP BY c.id),
ovl AS (SELECT p.id AS src_id, n.id AS dst_id, (least(p.x0 + 4, n.x0 + 8) - greatest(p.x0, n.x0)) * (least(p.y0 + 4, n.y0 + 8) - greatest(p.y0, n.y0)) / 16.0 AS weight,
 p.x0 >= n.x0 AND p.x0 + 4 <= n.x0 + 8 AND p.y0 >= n.y0 AND p.y0 + 4 <= n.y0 + 8 AS inside
 FROM par p JOIN nat n ON p.x0 <= n.x0 + 8 AND n.x0 <= p.x0 + 4 AND p.y0 <= n.y0 + 8 AND n.y0 <= p.y0 + 4)
"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, _SQL + sql
        return f

    return keep


def _r(name: str):
    return F.round(name, 7).alias(name)


def _customers_to_nations(spark: SparkSession, d: str) -> DataFrame:
    return mp.map_centroid(ly.customers(spark, d), ly.nations(spark, d), SIDE)


def _up(spark: SparkSession, d: str, **aggs) -> DataFrame:
    out = st.upscale(_customers_to_nations(spark, d), ly.customers(spark, d), aggs)
    return out.select("id", *(_r(a) for a in aggs))


def _parts_up(spark: SparkSession, d: str, mode, **aggs) -> DataFrame:
    out = st.upscale(mode(ly.parts(spark, d), ly.nations(spark, d), SIDE), ly.parts(spark, d), aggs)
    return out.select("id", *(_r(a) for a in aggs))


@query("SELECT dst_id AS id, round(sum(bal), 7) AS total FROM cen JOIN cus ON src_id = id GROUP BY dst_id")
def q_centroid_sum(spark: SparkSession, d: str) -> DataFrame:
    return _up(spark, d, total=st.sum_up("bal"))


@query("SELECT src_id, dst_id FROM cen")
def q_centroid_map(spark: SparkSession, d: str) -> DataFrame:
    return _customers_to_nations(spark, d).select("src_id", "dst_id")


@query("SELECT dst_id AS id, round(sum(bal * w) / sum(w), 7) AS mean FROM cen JOIN cus ON src_id = id GROUP BY dst_id")
def q_weighted_mean_up(spark: SparkSession, d: str) -> DataFrame:
    return _up(spark, d, mean=st.mean_up("bal", F.col("w")))


@query("SELECT dst_id AS id, max(bal) AS top, min(bal) AS low FROM cen JOIN cus ON src_id = id GROUP BY dst_id")
def q_max_min_up(spark: SparkSession, d: str) -> DataFrame:
    return _up(spark, d, top=st.max_up("bal"), low=st.min_up("bal"))


@query("SELECT dst_id AS id, round(sum(price * weight), 7) AS total FROM ovl JOIN par ON src_id = id GROUP BY dst_id")
def q_exact_sum(spark: SparkSession, d: str) -> DataFrame:
    return _parts_up(spark, d, mp.map_exact, total=st.sum_up("price", F.col("weight")))


@query("SELECT dst_id AS id, CASE WHEN sum(weight) > 0 THEN round(sum(price * weight) / sum(weight), 7) END AS mean FROM ovl JOIN par ON src_id = id GROUP BY dst_id")
def q_exact_mean(spark: SparkSession, d: str) -> DataFrame:
    return _parts_up(spark, d, mp.map_exact, mean=st.mean_up("price", F.col("weight")))


@query("SELECT dst_id AS id, round(avg(price), 7) AS mean FROM ovl JOIN par ON src_id = id GROUP BY dst_id")
def q_intersects_mean(spark: SparkSession, d: str) -> DataFrame:
    return _parts_up(spark, d, mp.map_intersects, mean=st.mean_up("price"))


@query(", ins AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY src_id) AS share FROM ovl WHERE inside) SELECT dst_id AS id, round(sum(price * share), 7) AS total FROM ins JOIN par ON src_id = id GROUP BY dst_id")
def q_touches_sum(spark: SparkSession, d: str) -> DataFrame:
    return _parts_up(spark, d, mp.map_touches, total=st.sum_up("price", F.col("weight")))


def _balances(spark: SparkSession, d: str) -> DataFrame:
    return _up(spark, d, bal=st.sum_up("bal"))


@query(", tot AS (SELECT dst_id, sum(bal) AS t, count(*) AS n FROM cen JOIN cus ON src_id = id GROUP BY dst_id) SELECT src_id AS id, round(t / n, 5) AS bal FROM cen JOIN tot USING (dst_id)")
def q_down_sum_equal(spark: SparkSession, d: str) -> DataFrame:
    return st.sum_down(_customers_to_nations(spark, d), _balances(spark, d), "bal").select("id", F.round("bal", 5).alias("bal"))


@query(", top AS (SELECT dst_id, max(bal) AS t FROM cen JOIN cus ON src_id = id GROUP BY dst_id) SELECT src_id AS id, max(t) AS bal FROM ovl JOIN top USING (dst_id) GROUP BY src_id")
def q_down_max(spark: SparkSession, d: str) -> DataFrame:
    mapping = mp.map_intersects(ly.parts(spark, d), ly.nations(spark, d), SIDE)
    return st.spread_down(mapping, _up(spark, d, bal=st.max_up("bal")), "bal", "max")


@query("SELECT min(x0) AS minx, min(y0) AS miny, max(x0 + 4) AS maxx, max(y0 + 4) AS maxy FROM par")
def q_level_bounds(spark: SparkSession, d: str) -> DataFrame:
    levels = Levels(SIDE)
    levels.add_level("part", ly.parts(spark, d))
    return levels.bounds("part")


_KNN = """, ncen AS (SELECT id, x0 + 4 AS x, y0 + 4 AS y FROM nat), near AS (SELECT c.id AS src_id, n.id AS dst_id, sqrt((c.x - n.x) ** 2 + (c.y - n.y) ** 2) AS distance,
 row_number() OVER (PARTITION BY c.id ORDER BY sqrt((c.x - n.x) ** 2 + (c.y - n.y) ** 2), n.id) AS rank FROM cus c CROSS JOIN ncen n), k AS (SELECT * FROM near WHERE rank <= 3)
"""


@query(_KNN + "SELECT src_id, dst_id, round(pow(distance + 1e-9, -2) / sum(pow(distance + 1e-9, -2)) OVER (PARTITION BY src_id), 7) AS weight FROM k")
def q_knn_map(spark: SparkSession, d: str) -> DataFrame:
    return nr.knn_mapping(ly.customers(spark, d), ly.nations(spark, d), SIDE, k=3).select("src_id", "dst_id", _r("weight"))


@query(_KNN + ", v AS (SELECT dst_id, sum(bal) AS bal FROM cen JOIN cus ON src_id = id GROUP BY dst_id) SELECT src_id AS id, round(sum(v.bal * pow(distance + 1e-9, -2)) / sum(pow(distance + 1e-9, -2)), 5) AS bal FROM k JOIN v USING (dst_id) GROUP BY src_id")
def q_smooth_mean(spark: SparkSession, d: str) -> DataFrame:
    mapping = nr.knn_mapping(ly.customers(spark, d), ly.nations(spark, d), SIDE, k=3)
    return nr.smooth_mean(mapping, _balances(spark, d), "bal").select("id", F.round("bal", 5).alias("bal"))


@query("""SELECT src_id, dst_id, round(distance, 6) AS distance FROM (SELECT s_suppkey AS src_id, o_orderkey AS dst_id,
 sqrt((s_suppkey * 977 % 4001 * 1.37::DOUBLE - 1500 - o_orderkey * 37 % 3203 / 7::DOUBLE) ** 2 + (s_suppkey * 613 % 4001 * 1.61::DOUBLE - 2500 - o_orderkey * 101 % 2999 / 11::DOUBLE) ** 2) AS distance FROM supplier, orders)
QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY distance, dst_id) <= 5""")
def q_nearest_far(spark: SparkSession, d: str) -> DataFrame:
    return nr.nearest(ly.depots(spark, d), ly.deliveries(spark, d), 4.0, k=5).select("src_id", "dst_id", F.round("distance", 6).alias("distance"))


_HOLES = ", h AS (SELECT id, x, y, w, CASE WHEN id % 5 > 0 THEN bal END AS bal FROM cus), pick AS (SELECT e.id, e.w, f.id AS donor, f.bal AS given, row_number() OVER (PARTITION BY e.id ORDER BY sqrt((e.x - f.x) ** 2 + (e.y - f.y) ** 2), f.id) AS rank FROM h e JOIN h f ON e.bal IS NULL AND f.bal IS NOT NULL)"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return ly.customers(spark, d).withColumn("bal", F.when(F.col("id") % 5 > 0, F.col("bal")))


@query(_HOLES + " SELECT h.id, coalesce(h.bal, given) AS bal, h.bal IS NULL AS filled FROM h LEFT JOIN pick ON h.id = pick.id AND rank = 1")
def q_nearest_fill(spark: SparkSession, d: str) -> DataFrame:
    return nr.fill_from_nearest(_holes(spark, d), "bal", "w", 1.0).select("id", "bal", "filled")


@query(_HOLES + ", g AS (SELECT donor, sum(w) AS gain FROM pick WHERE rank = 1 GROUP BY donor) SELECT h.id, CASE WHEN bal IS NULL THEN 0.0 ELSE w + coalesce(gain, 0.0) END AS w FROM h LEFT JOIN g ON h.id = donor")
def q_relocate_weight(spark: SparkSession, d: str) -> DataFrame:
    return nr.relocate_weight(_holes(spark, d), "bal", "w", 1.0)[0].select("id", "w")
