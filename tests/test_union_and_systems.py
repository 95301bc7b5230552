import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.functions import projections as pr
from strata.functions.strategies import Sum
from strata.levels import Levels
from strata.operators import nearest as nr
from strata.operators import shapes as sh
from strata.operators import union as un

NESTED = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
POINT = "array<array<struct<x:double,y:double>>>"


def square(x, y, w):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + w)), (float(x), float(y + w))]


def flat(*polygons):
    return sh.flat(pa.array([[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in polygons], NESTED), pa.array([2] * len(polygons), pa.int32()))


def union(spark, rows):
    layer = spark.createDataFrame(rows, f"g string, rings {POINT}")
    out = un.dissolved(layer, "g", 1.0).withColumn("m", sh.measures("shape", "dim")).collect()
    return {r["id"]: (r["m"]["area"], r["m"]["length"], sorted(len(part) for part in r["shape"])) for r in out}


def test_union_of_a_coverage(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [("frame", [square(x, y, 1) if (x + y) % 2 else square(x, y, 1)[::-1]]) for x, y in ring]  # a hole is left, directions differ
    rows += [("t", [square(0, 0, 2)]), ("t", [square(2, 0, 1)]), ("t", [square(2, 1, 1)]), ("t", [square(0, 2, 3)])]  # sides shared in part
    rows += [("corner", [square(0, 0, 1)]), ("corner", [square(1, 1, 1)]), (None, [square(5, 5, 1)]), (None, [square(6, 5, 1)])]
    rows += [("plug", [square(0, 0, 3), square(1, 1, 1)]), ("plug", [square(1, 1, 1)]), ("far", [square(0, 0, 1), square(4, 4, 1)])]
    got = union(spark, rows)
    assert got["frame"][:2] == pytest.approx((8, 16)) and len(got["frame"][2]) == 2
    assert got["t"][:2] == pytest.approx((15, 16)) and len(got["t"][2]) == 1
    assert got["corner"] == (2, 8, [5, 5]) and got[None][:2] == (2, 6)
    assert got["plug"][:2] == (9, 12) and got["far"][0] == 2 and len(got["far"][2]) == 2
    slanted = union(spark, [("s", [[(0.1, 0.2), (1.3, 0.7), (0.4, 1.9)]]), ("s", [[(1.3, 0.7), (0.4, 1.9), (1.7, 2.3)]])])
    assert len(slanted["s"][2]) == 1 and slanted["s"][2] == [5]
    assert union(spark, rows[:0]) == {}


def test_long_rings_are_stitched(spark):
    steps = [("g", [[(float(k), 0.0), (k + 1.0, 0.0), (k + 1.0, 1.0 + k % 2), (float(k), 1.0 + k % 2)]]) for k in range(200)]
    area, length, sizes = union(spark, steps)["g"]
    assert area == pytest.approx(300) and len(sizes) == 1 and length == pytest.approx(200 + 200 + 1 + 2 + 199)


def test_systems_round_trip():
    rng = np.random.default_rng(0)
    for crs, middle in (("EPSG:32633", 15), ("EPSG:32719", -69), ("EPSG:3857", 0), ("EPSG:4326", 0), ("EPSG:32601", -177)):
        lng, lat = middle + rng.uniform(-4, 4, 1000), rng.uniform(-80, 80, 1000)
        back = pr.to_degrees(*pr.from_degrees(lng, lat, crs), crs)
        assert np.abs((back[0] - lng + 180) % 360 - 180).max() * 111e3 < 1e-3 and np.abs(back[1] - lat).max() * 111e3 < 1e-3
    for bad in ("EPSG:32661", "EPSG:9999", "x"):
        with pytest.raises(ValueError):
            pr.zone_of(bad)


def test_measures_on_the_ellipsoid_against_published_values():
    assert pr.geodesic_length([0.0, 0.0, 3.0], [0.0, 0.0, 3.0], [0.0, 1.0, 3.0], [90.0, 0.0, 3.0]) == pytest.approx([10001965.7293, 111319.490793, 0], abs=1e-4)
    # the coast of Antarctica in eighteen corners, round the pole; a degree square; an octant; holes
    coast = [(-58, -63.1), (-74, -72.9), (-102, -71.9), (-102, -74.9), (-131, -74.3), (-163, -77.5), (163, -77.4), (172, -71.7), (140, -65.9), (113, -65.7), (88, -66.6), (59, -66.9), (25, -69.8), (-4, -70.0), (-14, -71.0), (-33, -77.3), (-46, -77.9), (-61, -74.7)]
    area, length = pr.geodesic(flat([coast], [square(0, 0, 1)], [[(0, 0), (90, 0), (0, 90)]], [square(0, 0, 10), square(2, 2, 3)], [square(0, 0, 10)], [square(2, 2, 3)]))
    assert area[:3] == pytest.approx([13662703680020.1, 12308778361.469, 510065621724088.5 / 8], rel=1e-9) and length[0] == pytest.approx(16831067.893, abs=1e-3)
    assert area[3] == pytest.approx(area[4] - area[5]) and length[3] == pytest.approx(length[4] + length[5])


def test_levels_of_degrees_measure_metres(spark):
    box = spark.createDataFrame([("a", 7.0, 48.0, 7.01, 48.01, 5.0), ("b", 7.01, 48.0, 7.02, 48.01, 1.0)], "id string, minx double, miny double, maxx double, maxy double, v double")
    small, wide = Levels(0.01, crs="EPSG:4326"), Levels(0.01, crs="EPSG:4326")
    small.add_level("box", box)
    wide.add_level("box", box.union(spark.createDataFrame([("far", -80.0, 0.0, -79.0, 1.0, 0.0)], box.schema)))
    near, far = ({r["id"]: r["area"] for r in g.geometry["box"].collect()} for g in (small, wide))
    assert near["a"] == pytest.approx(829470, abs=1) and far["a"] == pytest.approx(829682.2558, abs=1e-3) and far["far"] == pytest.approx(12308778361.469, rel=1e-9)
    place = pr.reprojected(spark.createDataFrame([("p", 350_000.0, 5_318_000.0, 350_000.0, 5_318_000.0, 2.0)], box.schema), "EPSG:32632", "EPSG:4326").first()
    assert (place["minx"], place["miny"]) == pytest.approx((6.98, 48.0), abs=0.02) and place["shape"] is None
    points = spark.createDataFrame([("p", 350_700.0, 5_318_000.0, 350_700.0, 5_318_000.0, 2.0)], box.schema)
    small.add_vector(points, "box", Sum(), "v", upward=True, crs="EPSG:32632")
    assert sum(r["v"] for r in small.tables["box"].collect()) in (0.0, 2.0)


def test_empty_cells_in_metres(spark):
    rows = [(f"c{k}", 7.0 + 0.001 * k, 48.0, 7.0 + 0.001 * k, 48.0, 5.0 if k == 0 else None, 10.0) for k in range(6)]  # 74.6 m apart
    cells = spark.createDataFrame(rows, "id string, minx double, miny double, maxx double, maxy double, v double, w double")
    out, lost = nr.relocate_weight(cells, "v", "w", 200.0, crs="EPSG:4326")  # within 300 metres
    assert lost.first()[0] == 10 and {r["id"]: r["w"] for r in out.collect()}["c0"] == 50
    filled = nr.handle_empty(cells, "v", "w", 200.0, most=160.0, crs="EPSG:4326").filter("filled").select(F.sort_array(F.collect_list("id"))).first()[0]
    assert filled == ["c1", "c2"]
