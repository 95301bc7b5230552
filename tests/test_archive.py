import json
import struct

import numpy as np
from pyspark.sql import functions as F

from strata.functions.strategies import Sum
from strata.levels import Levels
from strata.operators import cells as cl
from strata.sources import archive as ar, level_tiles as lt


def varints(data):
    out, at = [], 0
    while at < len(data):
        n = shift = 0
        while True:
            b = data[at]
            n, shift, at = n | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                break
        out.append(n)
    return out


def entries(data):
    n, *rest = varints(data)
    ids, runs, lengths, offsets = np.cumsum(rest[:n]).tolist(), rest[n : 2 * n], rest[2 * n : 3 * n], []
    for k, v in enumerate(rest[3 * n :]):
        offsets.append(offsets[-1] + lengths[k - 1] if v == 0 else v - 1)
    return list(zip(ids, runs, lengths, offsets))


def read(data, number):
    """The bytes of a tile, found through the directories."""
    root, root_n, _, _, leaf, _, body, _ = struct.unpack_from("<8Q", data, 8)
    found = entries(data[root : root + root_n])
    for _ in range(3):
        hit = [e for e in found if e[0] <= number]
        if not hit:
            return None
        first, run, length, offset = hit[-1]
        if run:
            return data[body + offset : body + offset + length] if number < first + run else None
        found = entries(data[leaf + offset : leaf + offset + length])


def test_numbers_follow_the_curve():
    assert [ar.tile_of(k) for k in range(5)] == [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0)]
    for z in (2, 5):
        places = [ar.tile_of(k) for k in range((4**z - 1) // 3, (4 ** (z + 1) - 1) // 3)]
        assert len(set(places)) == 4**z and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(places, places[1:]))
        z_, x, y = (np.array(v) for v in zip(*places))
        assert ar.tile_ids(z_, x, y).tolist() == list(range((4**z - 1) // 3, (4 ** (z + 1) - 1) // 3))
    assert ar.tile_of(int(ar.tile_ids([20], [654321], [123456])[0])) == (20, 654321, 123456)


def archive(spark, tmp_path, tiles, **settings):
    path = str(tmp_path / "a.pmtiles")
    rows = [(z, x, y, bytearray(t)) for (z, x, y), t in tiles.items()]
    told = ar.write_archive(spark.createDataFrame(rows, "z int, x long, y long, tile binary"), path, {"name": "test"}, **settings)
    return (tmp_path / "a.pmtiles").read_bytes(), told


def test_each_tile_is_found(spark, tmp_path):
    tiles = {(z, x, y): b"sea" if x > 5 else f"{z}/{x}/{y}".encode() * (1 + x) for z in range(5) for x in range(2**z) for y in range(2**z) if (x + y) % 7}
    for leaf in (4096, 10):
        data, told = archive(spark, tmp_path, tiles, leaf=leaf)
        assert data[:8] == b"PMTiles\x03" and told["tiles"] == len(tiles) and told["contents"] == len(set(tiles.values())) and told["entries"] < len(tiles)
        for z in range(5):
            for x in range(2**z):
                for y in range(2**z):
                    assert read(data, int(ar.tile_ids([z], [x], [y])[0])) == tiles.get((z, x, y))
        head = struct.unpack_from("<11Q6B4i", data, 8)
        assert json.loads(data[head[2] : head[2] + head[3]]) == {"name": "test"} and head[5] == (0 if leaf == 4096 else head[5]) and head[15:17] == (0, 4) or head[15:17] == (1, 4)
        assert head[6] + head[7] == len(data) == head[6] + sum(map(len, set(tiles.values())))


def test_archives_without_tiles_and_with_repeated_rows(spark, tmp_path):
    data, told = archive(spark, tmp_path, {})
    assert told == {"tiles": 0, "entries": 0, "contents": 0} and len(data) == 127 + 1 + len(b'{"name": "test"}')
    twice = spark.createDataFrame([(1, 0, 1, bytearray(b"t"))] * 3, "z int, x long, y long, tile binary")
    assert ar.write_archive(twice, str(tmp_path / "b"))["tiles"] == 1
    assert read((tmp_path / "b").read_bytes(), 2) == b"t"
    assert twice.select(F.max(ar.tile_id("z", "x", "y"))).first()[0] == 2


def test_levels_in_one_archive_or_by_chunks(spark, tmp_path):
    rows = [(k, 10 + k % 8 * 0.5, 45 + k // 8 * 0.5, float(k)) for k in range(64)]
    layer = spark.createDataFrame(rows, "id long, minx double, miny double, v double").withColumns({"maxx": F.col("minx") + 0.2, "maxy": F.col("miny") + 0.2})
    layer = layer.unionByName(spark.createDataFrame([(99, None, None, 1.0, None, None)], "id long, minx double, miny double, v double, maxx double, maxy double"))
    one = lt.write_level_tiles(layer, str(tmp_path), "a", [3, 6], ["v"]).collect()
    assert [(r["path"], r["chunk"], r["rows"]) for r in one] == [(f"{tmp_path}/a.pmtiles", None, 64)]
    z, x, y = 6, *(int(v) for v in spark.range(1).select(cl.tile_x(F.lit(10.1), 6), cl.tile_y(F.lit(45.1), 6)).first())
    number = int(ar.tile_ids(np.array([z]), np.array([x]), np.array([y]))[0])
    assert read((tmp_path / "a.pmtiles").read_bytes(), number)
    many = lt.write_level_tiles(layer, str(tmp_path), "a", [3, 6], ["v"], most=20).collect()
    assert len(many) > 2 and sum(r["rows"] for r in many) == 64 and max(r["rows"] for r in many) <= 20
    assert sorted(p.name for p in tmp_path.glob("*.pmtiles")) == sorted(r["path"].rsplit("/", 1)[1] for r in many)  # the old one is gone
    assert any(read((tmp_path / r["path"]).read_bytes(), number) for r in many)


def test_archives_of_a_graph(spark, tmp_path):
    graph = Levels(1.0, "EPSG:4326")
    box = lambda i, x, y, s, v: (i, x, y, x + s, y + s, v)
    schema = "id string, minx double, miny double, maxx double, maxy double, v double"
    graph.add_level("wide", spark.createDataFrame([box("w", 8.0, 40.0, 2.0, None)], schema).drop("v"))
    graph.add_level("fine", spark.createDataFrame([box("a", 8.0, 40.0, 0.5, 1.0), box("b", 9.0, 41.0, 0.5, 4.0)], schema), strategies=Sum(), parent="wide")
    made = lt.write_graph_tiles(graph, str(tmp_path), {"wide": ["v"], "fine": ["v"]}, deepest_zoom=5, zooms={"wide": (0, 2), "fine": (3, 25)}).collect()
    assert [(r["level"], r["rows"], r["chunk"]) for r in made] == [("wide", 1, None), ("fine", 2, None)] and all(r["tiles"] >= 3 for r in made)
