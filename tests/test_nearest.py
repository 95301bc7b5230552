import math

import numpy as np
import pytest

from strata.operators import nearest as nr


def layer(spark, points, values=None):
    rows = [(i, float(x), float(y), float(x), float(y), (values or {}).get(i), 1.0) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "id long, minx double, miny double, maxx double, maxy double, v double, w double")


def brute(src, dst, k):
    return {(i, j) for i, a in enumerate(src) for _, j in sorted((math.dist(a, b), j) for j, b in enumerate(dst))[:k]}


def test_all_sources_are_mapped(spark):
    src = [(0, 0), (1, 1), (500, 0), (-3000, 7), (500, 0)]
    dst = [(0, 1), (2, 2), (2, 2), (2, 2), (9000, 0)]
    for k in (1, 2, 4, 6):
        got = {(r["src_id"], r["dst_id"]) for r in nr.nearest(layer(spark, src), layer(spark, dst), 1.0, k).collect()}
        assert got == brute(src, dst, k)
    weights = nr.knn_mapping(layer(spark, src), layer(spark, dst), 1.0).groupBy("src_id").agg({"weight": "sum"}).collect()
    assert len(weights) == 5 and all(abs(r[1] - 1) < 1e-9 for r in weights)
    assert nr.nearest(layer(spark, src), layer(spark, []), 1.0).count() == 0 == nr.nearest(layer(spark, []), layer(spark, dst), 1.0).count()


def test_far_donors(spark):
    holes = layer(spark, [(0, 0), (250, 0), (1000, 0)], {0: 5.0})
    filled = {r["id"]: (r["v"], r["filled"]) for r in nr.fill_from_nearest(holes, "v", "w", 1.0).collect()}
    assert filled == {0: (5.0, False), 1: (5.0, True), 2: (5.0, True)}
    moved, lost = nr.relocate_weight(holes, "v", "w", 1.0)
    assert {r["id"]: r["w"] for r in moved.collect()} == {0: 2.0, 1: 0.0, 2: 0.0} and lost.first()["excluded"] == 1.0


@pytest.mark.parametrize("size", [0.5, 40.0])
def test_pyramid_of_bins_equals_all_distances(spark, monkeypatch, size):
    """A crowd, a sparse field, copies and equal distances; sources in the crowd, between and far away."""
    monkeypatch.setattr(nr, "FEW", 0)
    monkeypatch.setattr(nr, "BINS", 20)  # so that both kinds of join are met
    random = np.random.default_rng(3)
    dst = [*map(tuple, random.normal(0, 0.3, (700, 2))), *map(tuple, random.uniform(-3000, 3000, (150, 2))), *[(7.0, 7.0)] * 9, (200.0, 0.0), (200.0, 2.0), (-5000.0, 1.0)]
    src = [*map(tuple, random.normal(0, 1, (40, 2))), *map(tuple, random.uniform(-4000, 4000, (40, 2))), (200.0, 1.0), (200.0, 1.0), (90000.0, -3.0), (7.0, 7.0)]
    for k in (1, 5):
        got = {(r["src_id"], r["dst_id"]) for r in nr.nearest(layer(spark, src), layer(spark, dst), size, k).collect()}
        assert got == brute(src, dst, k)


def test_fewer_destinations_than_wanted(spark, monkeypatch):
    monkeypatch.setattr(nr, "FEW", 0)
    src, dst = [(0, 0), (100, 3), (100, 3), (-7, 1e6)], [(50, 50), (50, 50), (51, -9e5)]
    got = {(r["src_id"], r["dst_id"]) for r in nr.nearest(layer(spark, src), layer(spark, dst), 1.0, 9).collect()}
    assert got == {(i, j) for i in range(4) for j in range(3)}
    assert nr.nearest(layer(spark, src), layer(spark, []), 1.0).count() == 0 == nr.nearest(layer(spark, []), layer(spark, dst), 1.0).count()
