import math
import random

import pytest
from pyspark.sql import functions as F

from strata.functions import measures as ms
from strata.operators import cells as cl
from strata.operators import lines as ln
from strata.operators import raster as ra
from strata.sources import kept, store, tiles

BOX = "minx double, miny double, maxx double, maxy double"


def boxes(spark, given):
    return spark.createDataFrame([(k, *map(float, b)) for k, b in given.items()], f"id string, {BOX}")


def raster(spark, array):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(array) for c, v in enumerate(row)], "row long, col long, value double")


def test_pixels_split_over_polygons(spark):
    two = boxes(spark, {"left": (0, 0, 1, 1), "right": (1, 0, 2, 1)})
    one = ra.to_polygons(raster(spark, [[20.0]]), ra.Affine(1, 0, 0.5, 0, -1, 1), two, 1.0)
    assert {r["id"]: r["value"] for r in one.collect()} == {"left": 10, "right": 10}
    rng = random.Random(0)
    array = [[rng.random() * 10 for _ in range(12)] for _ in range(12)]
    array[3][4], array[5][5] = float("nan"), -9999.0
    grid = boxes(spark, {f"{x},{y}": (3.5 * x, 3.5 * y, 3.5 * x + 3.5, 3.5 * y + 3.5) for x in range(4) for y in range(4)})
    got = ra.to_polygons(raster(spark, array), ra.Affine(1, 0, 0, 0, -1, 12), grid, 3.5, nodata=-9999.0)
    total = sum(v for row in array for v in row if v == v and v >= 0)
    assert sum(r["value"] for r in got.collect()) == pytest.approx(total, rel=1e-9)
    assert ra.valid_totals(raster(spark, array), -9999.0).first()["total"] == pytest.approx(total)
    with pytest.raises(NotImplementedError):
        ra.to_polygons(raster(spark, array), ra.Affine(1, 0.5, 0, 0, -1, 12), grid, 3.5)
    with pytest.raises(ValueError):
        ra.Affine(0, 0, 0, 0, 0, 0).pixel(F.lit(1), F.lit(1))


def test_rasters_keep_their_total_in_cells(spark):
    rng = random.Random(1)
    array = [[rng.random() * 100 for _ in range(10)] for _ in range(10)]
    place, total = ra.Affine(0.1, 0, 10, 0, -0.1, 48), sum(map(sum, array))
    for made in (ra.to_cells(raster(spark, array), place, 12, 0.1), ra.to_cells_nearest(raster(spark, array), place, 11), ra.to_cells_by_centre(raster(spark, array), place, 10, 10, 14)):
        assert sum(r["value"] for r in made.collect()) == pytest.approx(total, rel=1e-6)
    whole = {r["cell"]: r["value"] for r in ra.to_cells(raster(spark, array), place, 12, 0.1).collect()}
    tiled = {r["cell"]: (r["value"], r["tile"]) for r in ra.to_cells_tiled(raster(spark, array), place, 12, 0.1).collect()}
    assert whole == pytest.approx({k: v for k, (v, _) in tiled.items()})
    with pytest.raises(ValueError):
        ra.to_cells_tiled(raster(spark, array), place, 5, 0.1)
    rates = ra.to_cells_auto(raster(spark, array), place, 10, 10, 14, is_count=False).collect()
    assert sum(r["value"] for r in rates) / len(rates) == pytest.approx(total / 100)
    empty = ra.to_cells_nearest(raster(spark, [[float("nan")]]), place, 9)
    assert empty.count() == 0


def test_cells_nest(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(300)], "lng double, lat double")
    cell = cl.cell_of(F.col("lng"), F.col("lat"), 12)
    made = points.select("lng", "lat", cell.alias("c"), cl.cell_of(F.col("lng"), F.col("lat"), 5).alias("up"))
    b, (x, y) = cl.bounds(F.col("c")), cl.centre(F.col("c"))
    rows = made.select("*", *(v.alias(k) for k, v in b.items()), cl.parent(F.col("c"), 5).alias("p"), cl.cell_of(x, y, 12).alias("again"), cl.ring(F.col("c")).alias("ring"), cl.area(F.col("up")).alias("big"), F.aggregate(cl.children(F.col("up"), 7), F.lit(0.0), lambda a, k: a + cl.area(k)).alias("parts")).collect()
    for r in rows:
        assert r["minx"] <= r["lng"] <= r["maxx"] and r["miny"] <= r["lat"] <= r["maxy"] and r["p"] == r["up"] and r["again"] == r["c"]
        assert len(set(r["ring"])) == 8 and r["c"] not in r["ring"] and r["parts"] == pytest.approx(r["big"])


def test_chunks_hold_all_rows_within_their_size(spark):
    rng = random.Random(3)
    points = [(i, 10 + rng.random() * 0.05, 48 + rng.random() * 0.05) if i % 3 else (i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(900)]
    df = spark.createDataFrame(points, "id long, lng double, lat double").withColumn("cell", cl.cell_of(F.col("lng"), F.col("lat"), 14))
    rows = cl.chunk_keys(df, most=40).collect()
    assert sorted(r["id"] for r in rows) == list(range(900))
    sizes = {}
    for r in rows:
        sizes[r["chunk"]] = sizes.get(r["chunk"], 0) + 1
    assert all(n <= 40 or k.startswith("res9_") for k, n in sizes.items()) and any(k.startswith("res4_") for k in sizes)


def test_samples_and_distance_joins(spark):
    line = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 3.0)], 7.0), (2, [(0.0, 50.0), (1.0, 50.0)], 9.0), (3, [(5.0, 5.0)], 1.0)], "id long, line array<struct<x:double,y:double>>, v double")
    got = sorted((r["id"], round(r["x"], 6), round(r["y"], 6)) for r in ln.densify(line, 4.0).collect())
    want = sorted([(1, round(10 * i / 3, 6), 0.0) for i in range(3)] + [(1, 10.0, 0.0), (1, 10.0, 3.0), (2, 0.0, 50.0), (2, 1.0, 50.0), (3, 5.0, 5.0)])
    assert got == want
    centres = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 30.0), ("c", 0.0, 400.0)], "id string, x double, y double")
    reached = {r["id"]: r["v"] for r in ln.edges_to_cells(line, centres, ["v"], edge=5.0, margin=0.0).collect()}
    assert reached == {"a": 7.0, "b": 9.0}
    assert {r["id"] for r in ln.edges_to_cells(line, centres, ["v"], edge=5.0, margin=0.0, fallback=None).collect()} == {"a"}
    level = ln.edges_to_level(line, boxes(spark, {"p": (-1, -1, 20, 20), "q": (-1, 40, 20, 60)}), 20.0, ["v"])
    assert {r["id"]: r["v"] for r in level.collect()} == {"p": 4.0, "q": 9.0}


def test_tables_of_mappings_and_tiles(spark, tmp_path):
    layer = boxes(spark, {"a": (0, 0, 1, 1), "b": (1, 0, 2, 1)})
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", "b", 1.0)], "src_id string, dst_id string, weight double")

    for force in (False, False, True):
        assert store.kept_mapping(str(tmp_path), "m", layer, layer, build, "centroid", force=force).count() == 1
    assert len(calls) == 2 and store.fingerprint(layer) == store.fingerprint(layer.orderBy(F.desc("id"))) != store.fingerprint(layer.filter("id = 'a'"))
    assert store.read_columns(spark, [], ["v", "w"], layer.schema.add("v", "double")).dtypes == [("v", "double"), ("w", "string")]
    assert store.load_mapping(spark, str(tmp_path), "other", "key") is None
    cells = spark.range(500).select(cl.cell_of(F.col("id") / 100, F.col("id") / 100, 12).alias("cell"), F.col("id").alias("v")).dropDuplicates(["cell"])
    store.write_tiles(cells, f"{tmp_path}/tiles", rows_per_file=10)
    back = store.read_columns(spark, f"{tmp_path}/tiles", ["cell", "v"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    assert store.read_columns(spark, [], ["v"]).count() == 0
    with pytest.raises(ValueError):
        store.read_columns(spark, f"{tmp_path}/tiles", ["geometry"])
    tiles.write_cell_tiles(cells, f"{tmp_path}/json", [0, 8], ["v"])
    assert spark.read.text(f"{tmp_path}/json").count() == 2 * cells.count()


def test_kept_mappings_follow_geometry(spark, tmp_path):
    squares = boxes(spark, {"a": (0, 0, 1, 1), "b": (1, 0, 2, 1)})
    cells = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (1.5, 0.5), (5.0, 5.0)], "x double, y double").select(cl.cell_of(F.col("x"), F.col("y"), 14).alias("cell"))
    for _ in range(2):
        found = kept.cell_polygon_mapping(str(tmp_path), cells, squares, 1.0)
        assert sorted(r["dst_id"] for r in found.collect()) == ["a", "b"]
    assert len(list(tmp_path.glob("cells_polygons__*"))) == 1
    assert kept.cell_polygon_mapping(str(tmp_path), cells, squares.filter("id = 'a'"), 1.0).count() == 1  # another geometry, another file
    assert len(list(tmp_path.glob("cells_polygons__*"))) == 2
    line = spark.createDataFrame([(1, [(0.0, 0.0), (30.0, 0.0)])], "id long, line array<struct<x:double,y:double>>")
    centres = spark.createDataFrame([("n", 15.0, 4.0), ("f", 15.0, 400.0)], "id string, x double, y double")
    for margin, files in ((0.0, 1), (0.0, 1), (3.0, 2)):
        assert [tuple(r) for r in kept.line_cell_mapping(str(tmp_path), line, centres, 5.0, margin).collect()] == [(1, "n")]
        assert len(list(tmp_path.glob("lines_cells__*"))) == files


def test_zooms():
    assert tiles.zoom_ranges({"a": 5.0}) == {"a": (0, 25)}
    assert tiles.zoom_ranges({"a": 1.0, "b": 1.0}) == {"a": (0, 11), "b": (12, 25)}
    for sizes in ({"a": 1e9, "b": 1e6, "c": 10.0}, {f"l{k}": 10.0**-k for k in range(20)}):
        ranges = list(tiles.zoom_ranges(sizes).values())
        assert ranges[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))
    with pytest.raises(ValueError):
        tiles.zoom_ranges({})


def test_metres(spark):
    rows = spark.createDataFrame([(-79.387139, 43.642567), (3.0, 0.0)], "x double, y double")
    got = [tuple(r) for r in rows.select(*ms.utm(F.col("x"), F.col("y"), 17), *ms.utm(F.col("x"), F.col("y"), 31)).collect()]
    assert got[0][:2] == pytest.approx((630084, 4833439), abs=2) and got[1][2:] == pytest.approx((500000, 0), abs=1e-6)
    assert ms.utm_zone(-79.4) == 17 and ms.utm_zone(180) == 60
    layer = boxes(spark, {"a": (7, 48, 7, 48), "b": (7.01, 48, 7.01, 48)})
    a, b = sorted(tuple(r) for r in ms.local_utm(layer).select("id", "minx", "miny").collect())
    far = spark.range(1).select(ms.distance(F.lit(7.0), F.lit(48.0), F.lit(7.01), F.lit(48.0)), ms.box_area(F.lit(7.0), F.lit(48.0), F.lit(7.01), F.lit(48.01)), ms.ring_area(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((7.0, 48.0), (7.01, 48.0), (7.01, 48.01), (7.0, 48.01)))))).first()
    assert math.dist(a[1:], b[1:]) == pytest.approx(far[0], rel=5e-3) and far[1] == pytest.approx(far[2], rel=1e-9) and far[1] == pytest.approx(far[0] * 1112, rel=1e-2)
