"""Deterministic layers over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 boxes, a column of boxes for each region."""
    n = _read(spark, sf_dir, "nation").withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    x, y = F.col("n_regionkey") * 8.0, F.col("k") * 8.0
    return n.select(F.col("n_nationkey").alias("id"), x.alias("minx"), y.alias("miny"), (x + 8).alias("maxx"), (y + 8).alias("maxy"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("r_regionkey") * 8.0
    return _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), x.alias("minx"), F.lit(0.0).alias("miny"), (x + 8).alias("maxx"), F.lit(40.0).alias("maxy"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("c_custkey") * 37) % 320 / 8, (F.col("c_custkey") * 101) % 320 / 8
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"), F.col("c_acctbal").alias("bal"), (F.col("c_custkey") % 7 + 1).cast("double").alias("w"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each order, in a field of some 460 by 270."""
    x, y = F.col("o_orderkey") * 37 % 3203 / 7, F.col("o_orderkey") * 101 % 2999 / 11
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each supplier, most of them far outside the field of the deliveries."""
    x, y = F.col("s_suppkey") * 977 % 4001 * 1.37 - 1500, F.col("s_suppkey") * 613 % 4001 * 1.61 - 2500
    x, y = x.cast("double"), y.cast("double")
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = ((F.col("p_partkey") * 29) % 37).cast("double"), ((F.col("p_partkey") * 53) % 36).cast("double")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("minx"), y.alias("miny"), (x + 4).alias("maxx"), (y + 4).alias("maxy"), F.col("p_retailprice").alias("price"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level line for each order, from its customer's point to the longitude of the next key's."""
    k = F.col("o_custkey")
    x0, x1, y = k * 37 % 320 / 8, (k + 1) * 37 % 320 / 8, k * 101 % 320 / 8
    point = lambda x: F.struct(x.alias("x"), y.alias("y"))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(point(x0), point(x1)).alias("line"), F.col("o_totalprice").alias("price"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 40 x 40 pixels: quantities by part and supplier keys."""
    row, col = (F.col("l_partkey") % 40).alias("row"), (F.col("l_suppkey") % 40).alias("col")
    return _read(spark, sf_dir, "lineitem").groupBy(row, col).agg(F.sum("l_quantity").alias("value"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower left half of each part's box, as a ring."""
    p = parts(spark, sf_dir)
    corner = lambda dx, dy: F.struct((F.col("minx") + dx).alias("x"), (F.col("miny") + dy).alias("y"))
    return p.withColumn("ring", F.array(corner(0, 0), corner(4, 0), corner(0, 4)))


def _points(x, y, offsets):
    return F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in offsets))


def bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each part: up the diagonal of its box and down its right side."""
    p = parts(spark, sf_dir)
    return p.select("id", "price", _points(F.col("minx"), F.col("miny"), [(0, 0), (4, 4), (4, 0)]).alias("line"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's box with a hole of a quarter of its area; the hole runs the same way round."""
    p = parts(spark, sf_dir)
    ring = lambda low, high: _points(F.col("minx"), F.col("miny"), [(low, low), (high, low), (high, high), (low, high)])
    return p.select("id", "price", F.array(ring(0, 4), ring(1, 3)).alias("rings"))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two unit squares in opposite corners of each part's box."""
    p = parts(spark, sf_dir)
    square = lambda at: _points(F.col("minx"), F.col("miny"), [(at, at), (at + 1, at), (at + 1, at + 1), (at, at + 1)])
    return p.select("id", "price", F.array(square(0), square(3)).alias("rings"))


def wedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper right half of each nation's box."""
    n = nations(spark, sf_dir)
    return n.select("id", _points(F.col("minx"), F.col("miny"), [(8, 0), (8, 8), (0, 8)]).alias("ring"))
