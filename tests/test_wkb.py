import json
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strata.levels import Levels
from strata.operators import cells as cl
from strata.operators import shapes as sh
from strata.sources import wkb


def corners(*points):
    return np.array(points, np.float64)


SQUARE, HOLE, FAR = (corners(*((x + a * w, y + b * w) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))) for x, y, w in ((0, 0, 10), (2, 2, 4), (20, 0, 3)))
ISLAND = corners((3, 3), (5, 3), (5, 5), (3, 5), (3, 3))


def test_known_bytes():
    assert wkb.encode(0, [corners((1, 2))]) == bytes.fromhex("0101000000000000000000f03f0000000000000040")
    big = struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    dim, parts = wkb.decode(big)
    assert dim == 0 and parts[0].tolist() == [[1, 2]]
    with_z = struct.pack("<BIIddd", 1, 0xA0000001, 4326, 1.0, 2.0, 9.0)  # a height and an SRID
    iso = struct.pack("<BIddd", 1, 1001, 1.0, 2.0, 9.0)
    assert wkb.decode(with_z)[1][0].tolist() == wkb.decode(iso)[1][0].tolist() == [[1, 2]]
    line, point = wkb.encode(1, [corners((0, 0), (1, 1))]), wkb.encode(0, [corners((5, 5))])
    mixed = struct.pack("<BII", 1, 7, 3) + point + line + struct.pack("<BII", 1, 7, 1) + line
    assert wkb.decode(mixed)[0] == 1 and len(wkb.decode(mixed)[1]) == 2
    assert wkb.decode(None) is None and wkb.decode(struct.pack("<BII", 1, 3, 0)) is None and wkb.decode(struct.pack("<BIdd", 1, 1, np.nan, np.nan)) is None
    with pytest.raises(ValueError):
        wkb.decode(struct.pack("<BII", 1, 15, 0))


def test_rings_are_nested():
    made = wkb.nested([HOLE, FAR, SQUARE[::-1], ISLAND])  # a hole, an island in it, another polygon
    shape = sorted((abs(p[0][:, 0]).max(), len(p)) for p in made)
    assert shape == [(5, 1), (10, 2), (23, 1)]
    dim, parts = wkb.decode(wkb.encode(2, [HOLE, FAR, SQUARE, ISLAND]))
    assert dim == 2 and len(parts) == 4 and wkb.encode(2, [HOLE, FAR, SQUARE, ISLAND])[1] == 6


def test_round_trip_and_levels(spark, tmp_path):
    rows = [("frame", 2, [SQUARE, HOLE]), ("two", 2, [SQUARE, FAR]), ("line", 1, [SQUARE[:3]]), ("lines", 1, [SQUARE[:3], FAR[:2]]), ("point", 0, [SQUARE[:1]]), ("points", 0, [SQUARE[:1], FAR[:1]])]
    binary = spark.createDataFrame([(i, bytearray(wkb.encode(d, p)), 1.0) for i, d, p in rows] + [("none", None, 1.0)], "id string, geometry binary, v double")
    back = wkb.decoded(binary).withColumn("m", sh.measures("shape", "dim"))
    got = {r["id"]: (r["dim"], r["m"]["area"], r["m"]["length"], len(r["shape"]), r["maxx"]) for r in back.collect()}
    assert got == {"frame": (2, 84, 56, 2, 10), "two": (2, 109, 52, 2, 23), "line": (1, 0, 20, 1, 10), "lines": (1, 0, 23, 2, 23), "point": (0, 0, 0, 1, 0), "points": (0, 0, 0, 2, 20)}
    again = {r["id"]: bytes(r["geometry"]) for r in wkb.encoded(wkb.decoded(binary)).collect()}
    assert again == {i: wkb.encode(d, p) for i, d, p in rows}
    level = Levels(5.0)
    level.add_level("all", binary)
    assert {r["id"]: r["geometry_type"] for r in level.geometry["all"].collect()}["two"] == "Polygon" and level.level("all").count() == 6
    files = wkb.write_geoparquet(wkb.decoded(binary).withColumn("k", F.lit("a")), str(tmp_path / "g"), "k", rows_per_file=2).collect()
    assert sum(r["rows"] for r in files) == 6 and len(files) > 1
    meta = json.loads(pq.read_schema(files[0]["path"]).metadata[b"geo"])
    assert meta["primary_column"] == "geometry" and meta["columns"]["geometry"]["encoding"] == "WKB"
    assert spark.read.parquet(str(tmp_path / "g")).select("id").distinct().count() == 6


def test_cells_as_geometry(spark, tmp_path):
    cells = spark.range(40).select(cl.cell_of(F.col("id") / 3, F.col("id") / 3, 10).alias("cell"), F.col("id").alias("v")).dropDuplicates(["cell"])
    files = wkb.write_cell_tiles(cells, str(tmp_path / "t"), 5)
    assert files.agg(F.sum("rows")).first()[0] == cells.count()
    back = wkb.decoded(spark.read.parquet(str(tmp_path / "t"))).select("id", "minx", "maxy").orderBy("id")
    want = cl.boxes(cells).select("id", "minx", "maxy").orderBy("id")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in want.collect()]
