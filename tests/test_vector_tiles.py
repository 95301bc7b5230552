import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import cells as cl
from strata.operators import shapes as sh
from strata.sources import vector_tiles as vt

PARTS = "array<array<struct<x:double,y:double>>>"


def varint(data, at):
    out = shift = 0
    while True:
        b = data[at]
        out, shift, at = out | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return out, at


def fields(data):
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 2:
            n, at = varint(data, at)
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 == 1:
            yield key >> 3, struct.unpack("<d", data[at : at + 8])[0]
            at += 8
        else:
            n, at = varint(data, at)
            yield key >> 3, n


def numbers(data):
    at, out = 0, []
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def read(tile):
    """{layer: (extent, [(attributes, kind, parts)])} of a tile."""
    layers = {}
    for _, body in fields(tile):
        every = list(fields(body))
        name = next(v for k, v in every if k == 1).decode()
        keys, values = [v.decode() for k, v in every if k == 3], []
        for k, v in every:
            if k == 4:
                (kind, raw), = fields(v)
                values.append({1: lambda r: r.decode(), 3: float, 6: lambda r: (r >> 1) ^ -(r & 1), 7: bool}[kind](raw))
        features = []
        for k, v in every:
            if k != 2:
                continue
            f = dict(fields(v))
            tags = numbers(f.get(2, b""))
            parts, x, y, code, at = [], 0, 0, numbers(f[4]), 0
            while at < len(code):
                what, n = code[at] & 7, code[at] >> 3
                at += 1
                for _ in range(n if what != 7 else 0):
                    x, y = x + ((code[at] >> 1) ^ -(code[at] & 1)), y + ((code[at + 1] >> 1) ^ -(code[at + 1] & 1))
                    at += 2
                    if what == 1:
                        parts.append([])
                    parts[-1].append((x, y))
            features.append(({keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}, f[3], parts))
        layers[name] = (dict((k, v) for k, v in every if k == 5)[5], features)
    return layers


def signed(p):
    p = np.array(p, float)
    return (p[:, 0] @ np.roll(p[:, 1], -1) - p[:, 1] @ np.roll(p[:, 0], -1)) / 2


def test_clipping_keeps_area_and_length():
    rng = np.random.default_rng(1)
    turn = np.sort(rng.uniform(0, 2 * math.pi, 30))
    star = np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(0.3, 1.5, (30, 1))
    grid = [(x, y) for x in np.arange(-2, 2, 0.5) for y in np.arange(-2, 2, 0.5)]
    bounds = np.array([(x, y, x + 0.5, y + 0.5) for x, y in grid])
    for dim in (1, 2):
        row = np.repeat(np.arange(len(grid)), 30)
        x, y, part, owner = vt.clipped(np.tile(star[:, 0], len(grid)), np.tile(star[:, 1], len(grid)), row, row, np.full(len(grid), dim), bounds)
        assert (x >= bounds[owner, 0] - 1e-12).all() and (y <= bounds[owner, 3] + 1e-12).all()
        pieces = [np.stack([x, y], 1)[part == k] for k in np.unique(part)]
        if dim == 2:
            assert sum(abs(signed(p)) for p in pieces) == pytest.approx(abs(signed(star)))
        else:
            want = sum(math.dist(p, q) for p, q in zip(star, star[1:]))
            assert sum(math.dist(p, q) for piece in pieces for p, q in zip(piece, piece[1:])) == pytest.approx(want)


def test_tiles_are_read_back(spark, tmp_path):
    hole = [[(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)], [(15.0, 15.0), (25.0, 15.0), (25.0, 25.0), (15.0, 25.0)]]
    polygons = sh.shaped(spark.createDataFrame([(1, hole, "frame", 2.5, 7, True), (2, [[(11.0, 11.0), (12.0, 11.0), (12.0, 12.0)]], None, float("nan"), -3, False)], f"id long, rings {PARTS}, name string, v double, n long, b boolean"))
    got = {(r["z"], r["x"], r["y"]): read(bytes(r["tile"])) for r in vt.tiles(polygons, [0, 4], ["name", "v", "n", "b"], "areas").collect()}
    extent, features = got[0, 0, 0]["areas"]
    assert extent == 4096 and features[0][0] == {"name": "frame", "v": 2.5, "n": 7, "b": True} and features[1][0] == {"n": -3, "b": False} and {f[1] for f in features} == {3}
    outer, inner = features[0][2]
    assert signed(outer) > 0 > signed(inner)  # y downwards: the outer ring turns clockwise on the screen
    x, y = vt.world(np.array([10.0, 30.0]), np.array([30.0, 10.0]))
    assert [min(p[0] for p in outer), max(p[0] for p in outer)] == np.round(x * 4096).tolist() and [min(p[1] for p in outer), max(p[1] for p in outer)] == np.round(y * 4096).tolist()
    # the pieces of zoom 4 hold the area of the frame once, but for the widened borders
    frames = vt.tile_features(polygons.filter("id = 1"), 4, buffer=0.0).select(sh.measures("part", F.lit(2))["area"].alias("a")).agg(F.sum("a")).first()[0]
    a, b = (np.diff(vt.world(np.array([lo, hi]), np.array([hi, lo]))).ravel() * 16 for lo, hi in ((10.0, 30.0), (15.0, 25.0)))
    assert frames == pytest.approx(a.prod() - b.prod())
    exact = sum(sum(signed(p) for p in f[2]) for (z, _, _), t in got.items() if z == 4 for f in t["areas"][1] if f[0].get("name")) / 4096**2
    assert exact >= frames and exact == pytest.approx(frames, rel=0.2)
    files = vt.write_tiles(vt.tiles(polygons, [4], ["name"]), str(tmp_path)).collect()
    assert files and all((tmp_path / str(r["z"]) / str(r["x"]) / f"{r['y']}.pbf").stat().st_size == r["bytes"] for r in files)


def test_lines_and_points_in_tiles(spark):
    lines = sh.shaped(spark.createDataFrame([(1, [(-170.0, 60.0), (170.0, 60.0)])], "id long, line array<struct<x:double,y:double>>"))
    rows = vt.tiles(lines, [2], []).collect()
    assert [r["x"] for r in sorted(rows, key=lambda r: r["x"])] == [0, 1, 2, 3] and all(read(bytes(r["tile"]))["layer"][1][0][1] == 2 for r in rows)
    points = spark.createDataFrame([(k, float(k), 0.0, float(k), 0.0) for k in range(-179, 180, 20)], "id long, minx double, miny double, maxx double, maxy double")
    rows = vt.tiles(points, [3], [], buffer=0.0).collect()
    assert sum(len(read(bytes(r["tile"]))["layer"][1]) for r in rows) == 18 * 1
    place = points.filter("id = 1").select(cl.tile_x(F.col("minx"), 3).alias("x"), cl.tile_y(F.col("miny"), 3).alias("y")).first()
    assert (place["x"], place["y"]) in {(r["x"], r["y"]) for r in rows}
    assert vt.tiles(points.limit(0), [3], []).count() == 0
