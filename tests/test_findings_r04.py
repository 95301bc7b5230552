import math

import duckdb
import pytest
from pyspark.sql import functions as F

import strata.more_queries  # noqa: F401
from strata import scratch
from strata.functions import strategies as st
from strata.operators import lines as ln
from strata.operators import mapping as mp
from strata.operators import nearest as nr
from strata.operators import raster as ra
from strata.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"

LINES = [(1, [(0.0, 0.0), (12.0, 0.0)], 3.0), (2, [(0.0, 0.0), (12.0, 0.0)], 5.0), (3, [(30.0, 1.0), (31.0, 1.0)], 2.0)]
PLACES = [(0.5, 0.0), (6.0, 0.5), (12.0, 1.0), (34.0, 1.0), (400.0, 0.0)]


def lines(spark):
    return spark.createDataFrame(LINES, "id int, line array<struct<x:double,y:double>>, v double")


def cells(spark, n):
    """n cells at each place; one more stands at two places, one twice at the same, and one has no place."""
    rows = [(k * 10 + p, *PLACES[p]) for k in range(n) for p in range(len(PLACES))]
    return spark.createDataFrame(rows + [(-1, *PLACES[0]), (-1, *PLACES[1]), (-2, *PLACES[1]), (-2, *PLACES[1]), (-3, None, 0.0)], "id int, x double, y double")


def samples():
    for key, line, v in LINES:
        (x0, y0), (x1, _) = line
        n = max(1, math.ceil((x1 - x0) / 5))
        yield from ((key, x0 + (x1 - x0) * k / n, y0, v) for k in range(n + 1))


def met(monkeypatch):
    """The numbers of centres that ``within`` gets."""
    seen, plain = [], ln.within

    def within(points, centres, radius):
        seen.append(centres.count())
        return plain(points, centres, radius)

    monkeypatch.setattr(ln, "within", within)
    return seen


def test_f1_joins_by_distance_deal_out_many_centres(spark, monkeypatch):
    points = spark.createDataFrame([(float(k), 0.0) for k in range(30)], "x double, y double")
    centres = points.withColumn("id", F.col("x").cast("int"))
    plan = lambda: ln.within(points, centres, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(scratch, "FEW", 29, raising=False)
    assert "BroadcastHashJoin" not in plan() and "SortMergeJoin" in plan()


@pytest.mark.parametrize("few", [0, 20_000])
def test_f1_cells_at_one_place_meet_samples_once(spark, monkeypatch, few):
    monkeypatch.setattr(scratch, "FEW", few, raising=False)
    seen, centres = met(monkeypatch), cells(spark, 40)
    got = sorted(map(tuple, ln.edges_to_cells(lines(spark), centres, ["v"], edge=1.0, margin=0.0, strategies=st.Sum(), fallback=5.0).collect()))
    assert seen == [9]  # five places, and those of two cells that stand twice
    hits, want = {}, []
    for r in centres.filter("x is not null").collect():
        hits.setdefault(r["id"], []).extend(v for _, x, y, v in samples() if math.hypot(x - r["x"], y - r["y"]) <= 2)
    for r in centres.filter("x is not null").collect():
        if not hits[r["id"]]:
            near = min((math.hypot(x - r["x"], y - r["y"]), x, y, v) for _, x, y, v in samples())
            want += [(r["id"], near[-1])] if near[0] <= 5 else []
    want += [(k, sum(v)) for k, v in hits.items() if v]
    assert got == sorted(want) and len(got) == 40 * 4 + 3


def test_f1_sources_at_one_place_look_for_their_nearest_once(spark, monkeypatch):
    seen, plain = [], nr._among_few
    monkeypatch.setattr(nr, "_among_few", lambda s, *rest: seen.append(s.count()) or plain(s, *rest))
    layer = lambda rows: spark.createDataFrame([(k, x, y, x, y) for k, x, y in rows], "id int, minx double, miny double, maxx double, maxy double")
    got = nr.nearest(layer([(k, float(k % 2), 0.0) for k in range(50)]), layer([(7, 0.0, 1.0), (8, 0.0, -1.0), (9, 3.0, 0.0)]), 1.0, 2).collect()
    assert seen == [2]
    assert sorted(map(tuple, got)) == sorted((k, g, math.hypot(k % 2, 1.0)) for k in range(50) for g in (7, 8))


@pytest.mark.parametrize("few", [0, 20_000])
def test_f2_lines_meet_places_not_cells(spark, monkeypatch, few):
    monkeypatch.setattr(scratch, "FEW", few, raising=False)
    seen, centres = met(monkeypatch), cells(spark, 40)
    got = sorted(map(tuple, ln.street_cell_mapping(lines(spark), centres, edge=1.0, margin=0.5).collect()))
    assert seen == [9]
    want = {(key, r["id"]) for r in centres.filter("x is not null").collect() for key, x, y, _ in samples() if math.hypot(x - r["x"], y - r["y"]) <= 2.5}
    assert got == sorted(want) and len(got) == 40 * 6 + 4


def boxes(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y), float(x + w), float(y + w)) for k, x, y, w in rows], "id int, minx double, miny double, maxx double, maxy double")


@pytest.mark.parametrize("few", [0, 20_000])
def test_f3_polygons_of_one_shape_are_met_once(spark, monkeypatch, few):
    monkeypatch.setattr(scratch, "FEW", few, raising=False)
    monkeypatch.setattr(mp, "FEW", few, raising=False)
    seen, plain = [], mp.related
    monkeypatch.setattr(mp, "related", lambda src, dst, size: seen.append(dst.count()) or plain(src, dst, size))
    at = [(k, k % 3, k % 2, 2) for k in range(60)] + [(99, 9, 9, 1), (7, 0, 0, 2)]  # 7 stands twice
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]
    layer = boxes(spark, at).withColumn("ring", F.lit(None).cast("array<struct<x:double,y:double>>"))
    layer = layer.unionByName(spark.createDataFrame([(k, 0.0, 0.0, 2.0, 2.0, ring) for k in (200, 201)], layer.schema))
    pixels = spark.createDataFrame([(r, c, r + 2.0 * c + 1) for r in range(4) for c in range(4)] + [(0, 8, 5.0)], "row int, col int, value double")
    got = {r["id"]: r["value"] for r in ra.to_polygons(pixels, ra.Affine(1, 0, 0, 0, 1, 0), layer, 1.0).collect()}
    assert seen == [8]
    want = {}
    for p in pixels.collect():
        met = []
        for k, x, y, w in at + [(200, 0, 0, None), (201, 0, 0, None)]:
            span = w or 2
            wide, high = min(x + span, p["col"] + 1) - max(x, p["col"]), min(y + span, p["row"] + 1) - max(y, p["row"])
            if wide < 0 or high < 0 or (w is None and p["col"] + p["row"] > 2):
                continue
            met.append((k, wide * high if w else max(0.0, wide * high * (1.0 if p["col"] + p["row"] < 1 else 0.5 if p["col"] + p["row"] == 1 else 0.0))))
        whole = sum(a for _, a in met)
        for k, a in met:
            if len(met) == 1 or whole > 0:
                want[k] = want.get(k, 0.0) + p["value"] * (1.0 if len(met) == 1 else a / whole)
    assert got == pytest.approx(want) and len(got) == 62


@pytest.mark.parametrize("few", [True, False])
def test_f3_pairs_send_few_rows_to_tasks_and_deal_out_many(spark, monkeypatch, few):
    """By the rows that there are: files tell little of what explode makes of them."""
    monkeypatch.setattr(mp, "FEW", 50 if few else 49, raising=False)
    src, dst = boxes(spark, [(k, k, 0, 0) for k in range(80)]), boxes(spark, [(k, k, 0, 1) for k in range(50)])
    found = mp.pairs(src, dst, 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == few == ("SortMergeJoin" not in plan)
    assert found.count() == 100


def copied(spark, folder, tables, n=4):
    """The tables of sf0.001, ``part`` n times under other keys at the same places; folder and parts of one copy."""
    shift = 37 * 36 * 40  # all formulas of the layers come round
    for t in tables:
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    one = spark.read.parquet(f"{DATA}/part.parquet")
    many = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("p_partkey", F.col("p_partkey") + F.col("k") * shift).drop("k")
    many.write.parquet(f"{folder}/part.parquet")
    return str(folder), one.count(), shift


def test_f4_copies_of_cells_take_no_more_pairs(spark, monkeypatch, tmp_path):
    folder, one, shift = copied(spark, tmp_path, ["orders"])
    seen = met(monkeypatch)
    got = {r["id"]: r["price"] for r in QUERIES["q_edges_distance"](spark, folder).collect()}
    assert len(seen) == 1 and seen[0] <= one
    want = {r["id"]: r["price"] for r in QUERIES["q_edges_distance"](spark, DATA).collect()}
    assert got == {k + c * shift: v for k, v in want.items() for c in range(4)} and want


def paired(monkeypatch):
    """The numbers of rows on both sides that ``pairs`` gets."""
    seen, plain = [], mp.pairs
    monkeypatch.setattr(mp, "pairs", lambda src, dst, size: seen.append((src.count(), dst.count())) or plain(src, dst, size))
    return seen


def against_sql(spark, name, folder):
    con = duckdb.connect()
    for t in ("nation", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    got = sorted(map(tuple, QUERIES[name](spark, folder).select(*names).collect()))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-3)


def test_f5_copies_of_parts_take_no_more_pairs(spark, monkeypatch, tmp_path):
    folder, one, _ = copied(spark, tmp_path, ["customer", "nation"])
    seen = paired(monkeypatch)
    against_sql(spark, "q_rescale", folder)
    assert len(seen) == 1 and seen[0][1] <= one


def test_f5_shares_come_from_one_run_of_the_mapping(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    mapping = spark.createDataFrame([(k, k % 3, 1.0) for k in range(12)], "src_id int, dst_id int, weight double").mapInArrow(seen, "src_id int, dst_id int, weight double")
    coarse = spark.createDataFrame([(0, 4.0), (1, 8.0), (2, 12.0), (3, 24.0)], "id int, v double")
    got = {r["id"]: r["v"] for r in st.sum_down(mapping, coarse, "v").collect()}
    assert got == pytest.approx({k: (1.0, 2.0, 3.0)[k % 3] * 2 for k in range(12)})
    assert runs.value == 12


def test_f6_copies_of_shapes_take_no_more_pairs(spark, monkeypatch, tmp_path):
    folder, one, _ = copied(spark, tmp_path, ["customer", "nation"])
    seen = paired(monkeypatch)
    against_sql(spark, "q_polygon_centroid", folder)
    assert len(seen) == 1 and seen[0][1] <= one


@pytest.mark.parametrize("few", [0, 20_000])
def test_f6_places_and_shapes_are_met_once(spark, monkeypatch, few):
    """Points, lines and polygons among boxes and rings, ids that stand several times, null coordinates."""
    monkeypatch.setattr(scratch, "FEW", few, raising=False)
    monkeypatch.setattr(mp, "FEW", few, raising=False)
    line = "array<struct<x:double,y:double>>"
    ring = lambda x, y: [(x, y), (x + 2.0, y), (x, y + 2.0)]
    box = lambda x, y, w: (float(x), float(y), float(x + w), float(y + w))
    dst = [(50 - k, *box(k % 3 * 2, 0, 2), None) for k in range(30)] + [(100 + k, *box(0, 0, 2), ring(0.0, 0.0)) for k in range(5)] + [(3, *box(8, 8, 2), ring(8.0, 8.0)), (3, *box(0, 4, 1), None)]
    points = [(k, *box(*((0.5, 0.5), (1.5, 1.5), (4.5, 1.0), (9.9, 9.9), (8.5, 8.5))[k % 5], 0)) for k in range(40)] + [(7, *box(0, 4, 0)), (77, None, None, None, None), (88, -0.0, 0.0, -0.0, 0.0)]
    src = [(*p, None) for p in points] + [(200, *box(0, 0, 4), None), (300, 1.0, 1.0, 5.0, 1.0, [(1.0, 1.0), (5.0, 1.0)])]
    layers = [spark.createDataFrame(rows, f"id int, minx double, miny double, maxx double, maxy double, {name} {line}") for rows, name in ((src, "line"), (dst, "ring"))]
    seen = paired(monkeypatch)
    got = {r["src_id"]: r["dst_id"] for r in mp.map_centroid(*layers, 1.0).collect()}
    assert seen[0] == (8, 6)  # five and three more places, of the box among the sources its centre

    def holds(d, x, y):
        _, x0, y0, x1, y1, corners = d
        return x0 <= x <= x1 and y0 <= y <= y1 and (corners is None or x - x0 + y - y0 <= 2)

    want = {}
    for k, x, y, *_ in [p for p in points if p[1] is not None] + [(200, 2.0, 2.0)]:
        ids = [d[0] for d in dst if holds(d, x, y)]
        if ids:
            want[k] = min([want.get(k, ids[0]), *ids])
    want[300] = min(d[0] for d in dst if d[1] <= 5 and d[3] >= 1 and d[2] <= 1 <= d[4])
    assert got == want
    assert {r["src_id"] for r in mp.map_centroid(layers[0].filter("line is null").drop("line"), layers[1], 1.0).collect()} == set(want) - {300}
