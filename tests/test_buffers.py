import math

import pytest
from pyspark.sql import functions as F

from strata.functions import projections as pr
from strata.functions.strategies import Sum
from strata.levels import Levels
from strata.operators import buffers as bf
from strata.operators import shapes as sh

PARTS = "array<array<struct<x:double,y:double>>>"


def layer(spark, rows):
    made = spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in p] for p in s], d) for i, s, d in rows], f"id string, shape {PARTS}, dim int")
    out = None
    for d, name in ((0, "lines"), (1, "lines"), (2, "rings")):
        part = sh.shaped(made.filter(F.col("dim") == d).withColumnRenamed("shape", name).drop("dim")).withColumn("dim", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


def measured(df):
    return {r["id"]: (r["m"]["area"], r["m"]["length"], len(r["shape"])) for r in df.withColumn("m", sh.measures("shape", "dim")).collect()}


def test_areas_in_closed_form(spark):
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]
    rows = [("point", [[(1, 2)]], 0), ("line", [[(0, 0), (10, 0)]], 1), ("bend", [[(0, 0), (10, 0), (10, 10)]], 1), ("square", [square], 2), ("frame", [square, hole[::-1]], 2), ("filled", [square, [(4.5, 4.5), (5.5, 4.5), (5.5, 5.5), (4.5, 5.5)]], 2)]
    rows += [("pair", [[(0, 0), (1, 0), (1, 1), (0, 1)], [(20, 0), (21, 0), (21, 1), (20, 1)]], 2), ("circle", [[(0, 0), (5, 0), (5, 5), (0, 5), (0, 0.5)]], 1), ("cross", [[(-5, 0), (5, 0)], [(0, -5), (0, 5)]], 1)]
    got = measured(bf.buffered(layer(spark, rows), 1.0, resolution=64))
    pi = math.pi
    want = {"point": (pi, 2 * pi, 1), "line": (20 + pi, 20 + 2 * pi, 1), "bend": (40 - 1 + pi * 5 / 4, None, 1), "square": (140 + pi, 40 + 2 * pi, 1), "frame": (140 + pi - 4, 40 + 2 * pi + 8, 2), "filled": (140 + pi, 40 + 2 * pi, 1), "pair": (2 * (5 + pi), 2 * (4 + 2 * pi), 2), "cross": (4 * 10 + 2 * pi - 4, None, 1)}
    for key, (area, length, parts) in want.items():
        assert got[key][0] == pytest.approx(area, rel=1e-3) and got[key][2] == parts, key
        assert length is None or got[key][1] == pytest.approx(length, rel=1e-3), key
    assert got["circle"][2] == 2  # closed by its width, with a hole left
    rough = measured(bf.buffered(layer(spark, rows[:1]), 1.0, resolution=2))["point"][0]
    assert rough == pytest.approx(8 * math.sin(pi / 4) / 2)
    border = bf.buffered(layer(spark, rows[3:5]), 1.0, ring_only=True, resolution=64)
    assert {r["dim"] for r in border.collect()} == {1} and measured(border)["square"][1] == pytest.approx(40 + 2 * pi, rel=1e-3)
    with pytest.raises(ValueError):
        bf.buffered(border, 0.0)


def test_degrees_are_buffered_in_metres(spark):
    place = layer(spark, [("p", [[(7.0, 48.0)]], 0)])
    wide = bf.buffered(place, 1000.0, pr.GEOGRAPHIC, resolution=32)
    area = wide.select(pr.geodesic_measures("shape", "dim")["area"]).first()[0]
    assert area == pytest.approx(math.pi * 1e6, rel=5e-3)
    assert bf.buffered(place.limit(0), 5.0, pr.GEOGRAPHIC).count() == 0


def test_injection_with_a_buffer_on_each_side(spark):
    box = "id string, minx double, miny double, maxx double, maxy double, v double"
    city = Levels(4.0)
    city.add_level("city", spark.createDataFrame([("a", 0.0, 0.0, 4.0, 4.0), ("b", 10.0, 0.0, 14.0, 4.0)], box.removesuffix(", v double")))
    spots = spark.createDataFrame([("p", 4.9, 4.0, 4.9, 4.0, 1.0), ("q", 4.9, 4.9, 4.9, 4.9, 2.0), ("r", 12.0, -0.5, 12.0, -0.5, 4.0)], box)
    read = lambda: {r["id"]: r["v"] for r in city.tables["city"].collect()}
    city.add_vector(spots, "city", Sum(), "v", upward=True)
    assert read() == {"a": 0, "b": 0}
    city.add_vector(spots, "city", Sum(), "v", upward=True, buffer=1.0)  # q lies beyond the round corner
    assert read() == {"a": 1, "b": 4}
    city.add_vector(spots, "city", Sum(), "v", upward=True, buffer=1.0, ring_only=True)
    assert read() == {"a": 0, "b": 0}
    road = spark.createDataFrame([("s", 9.0, 2.0, 9.0, 2.0, 6.0)], box)
    city.add_vector(road, "city", Sum(mode="intersects"), "v", upward=False, buffer=1.5)
    assert read() == {"a": 0, "b": 6}
