import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.operators import lines as ln
from strata.operators import mapping as mp
from strata.operators import shapes as sh

NESTED = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
SCHEMA = "id string, shape array<array<struct<x:double,y:double>>>, dim int"


def flat(shapes, dims):
    rows = [None if s is None else [[{"x": x, "y": y} for x, y in part] for part in s] for s in shapes]
    return sh.flat(pa.array(rows, NESTED), pa.array(dims, pa.int32()))


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]


HOLE, PAIR = [square(0, 0, 10), square(2, 2, 4)], [square(0, 0, 2), square(5, 5, 2)]


def star(rng, cx, cy, n, low, high):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + math.cos(t) * r, cy + math.sin(t) * r) for t, r in ((t, rng.uniform(low, high)) for t in turns)]


def hit(rings, xs, ys):
    out = np.zeros(xs.shape, bool)
    for ring in rings:
        for p, q in zip(ring, [*ring[1:], ring[0]]):
            with np.errstate(divide="ignore", invalid="ignore"):
                out ^= ((p[1] > ys) != (q[1] > ys)) & (xs < (q[0] - p[0]) * (ys - p[1]) / (q[1] - p[1]) + p[0])
    return out


@pytest.mark.parametrize(
    ("a", "dim_a", "b", "dim_b", "meets", "part"),
    [
        (HOLE, 2, [square(1, 1, 2)], 2, True, 3),
        (PAIR, 2, [square(1, 1, 5)], 2, True, 2),
        ([square(0, 0, 1)], 2, [square(1, 0, 1)], 2, True, 0),  # a side in common
        ([square(0, 0, 1)], 2, [square(1.6, 0, 1)], 2, False, 0),
        ([square(3, 3, 1)], 2, HOLE, 2, False, 0),  # all in the hole
        ([square(0, 0, 10)], 2, [square(0, 0, 10)[::-1] + [(0, 10)]], 2, True, 100),  # closed, the other way round
        ([[(-1, -1), (12, 12)]], 1, HOLE, 2, True, 6 * math.sqrt(2)),
        ([[(3, 3), (5, 5)]], 1, HOLE, 2, False, 0),
        ([[(2, 0), (2, 8)]], 1, HOLE, 2, True, 8),  # partly along the hole's side
        ([[(0, 20), (0, 12), (20, 12)]], 1, HOLE, 2, False, 0),  # its box meets, the line does not
        ([[(3, 3)]], 0, HOLE, 2, False, 0),
        ([[(2, 3)]], 0, HOLE, 2, True, 1),
        ([[(0, 0), (1, 1)]], 1, [[(0.5, 0.5), (3, 3)]], 1, True, math.sqrt(0.5)),
        ([[(0, 0), (4, 0)]], 1, [[(1, 0), (2, 0), (2, 1), (3, 0)]], 1, True, 1),
        ([[(1, 1)]], 0, [[(1, 1)]], 0, True, 1),
        (HOLE, 2, [[(-5, 1), (5, 1)]], 1, True, 0),
        (None, 2, HOLE, 2, False, 0),
        ([], 1, HOLE, 2, False, 0),
    ],
)
def test_relations(a, dim_a, b, dim_b, meets, part):
    got = sh.related(flat([a, a], [dim_a] * 2), flat([b, b], [dim_b] * 2))
    assert got[0].tolist() == [meets] * 2 and got[1] == pytest.approx([part] * 2)


def test_areas_and_lengths_against_a_raster():
    rng = random.Random(4)
    a = [[star(rng, 0, 0, 9, 2, 4), star(rng, 0, 0, 7, 0.5, 1.9)] for _ in range(30)]
    b = [[star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), 8, 1, 4)] for _ in range(30)]
    xs, ys = np.meshgrid(np.linspace(-8, 8, 700), np.linspace(-8, 8, 700))
    meets, part = sh.related(flat(a, [2] * 30), flat(b, [2] * 30))
    assert part == pytest.approx([(hit(p, xs, ys) & hit(q, xs, ys)).mean() * 256 for p, q in zip(a, b)], abs=0.3) and (meets | (part == 0)).all()
    m = sh.measured(flat(a, [2] * 30))
    for k, rings in enumerate(a):
        h = hit(rings, xs, ys)
        assert m.area[k] == pytest.approx(h.mean() * 256, abs=0.6) and (m.cx[k], m.cy[k]) == pytest.approx((xs[h].mean(), ys[h].mean()), abs=0.05)
        assert hit(rings, m.px[k : k + 1], m.py[k : k + 1]).all()
    lines = [[[(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(5)]] for _ in range(30)]
    _, part = sh.related(flat(lines, [1] * 30), flat(a, [2] * 30))
    t = (np.arange(4000) + 0.5) / 4000
    for k, ((line,), rings) in enumerate(zip(lines, a)):
        want = sum(hit(rings, p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])).mean() * math.dist(p, q) for p, q in zip(line, line[1:]))
        assert part[k] == pytest.approx(want, abs=0.02)


def test_shares_of_any_line_sum_to_its_length_inside(spark):
    rng = random.Random(5)
    lines = {f"l{k}": [[(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randint(2, 6))]] for k in range(60)}
    grid = {f"{x}{y}": [square(3 * x, 3 * y, 3)] for x in range(3) for y in range(3)}
    src = sh_layer(spark, lines, 1)
    rows = mp.map_exact(src, sh_layer(spark, grid, 2), 3.0).groupBy("src_id").agg(F.sum("weight").alias("w")).collect()
    assert len(rows) == 60 and all(r["w"] == pytest.approx(1) for r in rows)
    first = {r["src_id"]: r["dst_id"] for r in mp.map_centroid(src, sh_layer(spark, grid, 2), 3.0).collect()}
    for k, (line,) in lines.items():
        met = [g for g, ring in grid.items() if sh.related(flat([[line]], [1]), flat([ring], [2]))[0][0]]
        assert first[k] == min(met)


def sh_layer(spark, shapes, dim):
    rows = [(k, [[(float(x), float(y)) for x, y in part] for part in s], dim) for k, s in shapes.items()]
    return sh.shaped(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("shape", "rings" if dim == 2 else "lines").drop("dim"))


def test_a_bend_beside_a_box_is_not_mapped_to_it(spark):
    line = spark.createDataFrame([("bend", [(0.0, 2.0), (0.0, 0.0), (2.0, 0.0)], 5.0), ("none", None, 1.0)], "id string, line array<struct<x:double,y:double>>, v double")
    boxes = spark.createDataFrame([("in", -1.0, -1.0, 0.5, 3.0), ("out", 1.0, 1.0, 3.0, 3.0)], "id string, minx double, miny double, maxx double, maxy double")
    assert [(r["src_id"], r["dst_id"]) for r in mp.map_intersects(line, boxes, 1.0).collect()] == [("bend", "in")]
    level = {r["id"]: r["v"] for r in ln.edges_to_level(line, boxes, 1.0, ["v"]).collect()}
    assert level == {"in": 5.0, "out": None}


def test_mixed_layers_and_empty_tables(spark):
    rows = [("box", 0.0, 0.0, 2.0, 2.0, None), ("ring", None, None, None, None, [[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]])]
    mixed = spark.createDataFrame(rows, "id string, minx double, miny double, maxx double, maxy double, rings array<array<struct<x:double,y:double>>>")
    bounds = sh.shaped(mixed.filter("id = 'ring'").drop("minx", "miny", "maxx", "maxy"))
    whole = sh.shaped(mixed.filter("id = 'box'")).unionByName(bounds)
    got = {(r["src_id"], r["dst_id"]): r["weight"] for r in mp.map_exact(whole, whole, 1.0).collect()}
    assert got == pytest.approx({("box", "box"): 1, ("box", "ring"): 0.5, ("ring", "box"): 1, ("ring", "ring"): 1})
    for mode in mp.MODES:
        assert mp.id_mapping(whole.limit(0), whole, 1.0, mode=mode).count() == 0
        assert mp.id_mapping(whole, whole.limit(0), 1.0, mode=mode).count() == 0
