"""Tile archives in one file (PMTiles, version 3): tiles in the order of a Hilbert curve, equal tiles stored once, runs of
equal neighbours as one entry, directories in two steps.

Offsets are prefix sums over range partitions, so tiles are written by many tasks as pieces of the archive; the driver sees a
row for each partition and each leaf directory. Only the last step, putting the pieces into one file, is a single stream.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import cut, shared_folder
from .vector_tiles import _varints

HEADER, FIRST = 127, 16384  # bytes of the header, and of header and root directory together at most
LEAF = 4096  # entries of a leaf directory at least


def tile_ids(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of tiles: all of the zooms above, then the place on the zoom's Hilbert curve."""
    z, x, y = (np.asarray(v, np.int64) for v in (z, x, y))
    out = (4**z.astype(np.int64) - 1) // 3
    for bit in range(int(z.max(initial=0)) - 1, -1, -1):
        on = bit < z
        side = np.int64(1) << bit
        rx, ry = (x & side) > 0, (y & side) > 0
        out = out + np.where(on, side * side * ((3 * rx) ^ ry), 0)
        flip = on & ~ry & rx
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        turn = on & ~ry
        x, y = np.where(turn, y, x) & (side - 1), np.where(turn, x, y) & (side - 1)
    return out


@F.arrow_udf(T.LongType())
def tile_id(z: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array(tile_ids(*(np.asarray(c.to_numpy(), np.int64) for c in (z, x, y))))


def directory(ids: np.ndarray, runs: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> bytes:
    """Entries as columns of whole numbers; an offset that follows the entry before is 0, others are one more."""
    follows = np.append(False, offsets[1:] == offsets[:-1] + lengths[:-1])
    numbers = np.concatenate([[len(ids)], np.diff(ids, prepend=0), runs, lengths, np.where(follows, 0, offsets + 1)])
    return _varints(numbers)[0].tobytes()


def _ranged(df: DataFrame, key: str, size: str, head: str) -> DataFrame:
    """Rows in order of the key over range partitions, with ``part`` and ``head``, the sum of ``size`` before each row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()))
    before, heads = 0, {}  # a row for each partition
    for r in dealt.groupBy("part").agg(F.sum(size).alias("n")).orderBy("part").collect():
        heads[r["part"]] = before
        before += r["n"]
    names = [f.name for f in dealt.schema]
    at, size_at = names.index("part"), names.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            part, n = batch.column(at).to_numpy(), batch.column(size_at).to_numpy()
            out = np.zeros(len(n), np.int64)
            for p in np.unique(part):
                own = part == p
                start = sums.get(int(p), heads[int(p)])
                total = np.cumsum(n[own])
                out[own], sums[int(p)] = start + total - n[own], start + int(total[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, head])

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField(head, T.LongType())]))


def write_archive(tiles: DataFrame, path: str, metadata: dict | None = None, leaf: int = LEAF) -> dict[str, int]:
    """Writes z, x, y, tile (one row a tile, none null) as one file; returns the numbers of tiles, entries and contents.

    Rows of one place are a fault of the input: the one with the smaller digest stays. An empty table gives an archive
    without tiles. The pieces lie in the shared scratch folder until the file is whole.
    """
    spark = tiles.sparkSession
    named = tiles.select(tile_id("z", "x", "y").alias("tile_id"), "z", "x", "y", "tile", F.sha2("tile", 256).alias("mark"))
    named = named.withColumn("length", F.octet_length("tile").cast("long"))
    places = named.groupBy("tile_id").agg(F.min_by(F.struct("mark", "length", "z", "x", "y"), "mark").alias("t")).select("tile_id", "t.*")
    places = cut(places)
    first = places.groupBy("mark").agg(F.min("tile_id").alias("first"), F.first("length").alias("length"))
    contents = cut(_ranged(first, "first", "length", "offset"))
    spots = places.join(contents.select("mark", "offset"), "mark").select("tile_id", "length", "offset")
    entries = cut(_ranged(_runs(spots), "tile_id", "one", "number"))
    total = entries.count()
    size = max(leaf, -(-total // 1500))  # entries of a leaf, so that the root stays small
    leaves = entries.groupBy(F.floor(F.col("number") / size).alias("leaf")).applyInArrow(_leaf, "leaf long, first long, body binary")
    leaves = leaves.orderBy("leaf").collect()  # at most about 1500 rows, of directories
    seen = places.agg(F.count("*"), F.min("z"), F.max("z"), F.min((F.col("x")) / F.pow(F.lit(2.0), "z")), F.max((F.col("x") + 1) / F.pow(F.lit(2.0), "z")), F.min(F.col("y") / F.pow(F.lit(2.0), "z")), F.max((F.col("y") + 1) / F.pow(F.lit(2.0), "z"))).first()
    kept, data = contents.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    meta = json.dumps(metadata or {}).encode()
    if len(leaves) <= 1 and HEADER + len(leaves[0]["body"] if leaves else b"\x00") <= FIRST:
        root, bodies = (bytes(leaves[0]["body"]) if leaves else b"\x00"), []
    else:
        bodies = [bytes(r["body"]) for r in leaves]
        sizes = np.array([len(b) for b in bodies], np.int64)
        root = directory(np.array([r["first"] for r in leaves], np.int64), np.zeros(len(leaves), np.int64), sizes, np.cumsum(sizes) - sizes)
    inner = sum(map(len, bodies))
    at = [HEADER, HEADER + len(root), HEADER + len(root) + len(meta), HEADER + len(root) + len(meta) + inner]
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v))))
    west, east, north, south = (seen[3] * 360 - 180, seen[4] * 360 - 180, lat(seen[5]), lat(seen[6])) if seen[0] else (0.0, 0.0, 0.0, 0.0)
    e7 = [round(v * 1e7) for v in (west, south, east, north)]
    head = b"PMTiles\x03" + struct.pack("<11Q", at[0], len(root), at[1], len(meta), at[2], inner, at[3], data, seen[0], total, kept)
    head += struct.pack("<6B4i", 1, 1, 1, 1, seen[1] or 0, seen[2] or 0, *e7) + struct.pack("<Bii", seen[1] or 0, (e7[0] + e7[2]) // 2, (e7[1] + e7[3]) // 2)

    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    root_of = lambda p: re.sub(r"^file:/+", "file:///", p)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the data, each under the offset of its first tile."""
        from pyspark import TaskContext

        out = name = None
        written: list[tuple[int, str]] = []
        system, base = _system(root_of(folder))
        system.create_dir(base, recursive=True)
        for batch in batches:
            for offset, tile in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name = f"{base}/{offset}-{TaskContext.get().taskAttemptId()}"
                    out = system.open_output_stream(name)
                    written.append((offset, name))
                out.write(tile)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in written], pa.int64()), pa.array([w[1] for w in written], pa.string())], ["offset", "path"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies_of = named.select("tile_id", "mark", "tile").join(contents.select(F.col("first").alias("tile_id"), "mark", "offset"), ["tile_id", "mark"])
    ordered = bodies_of.dropDuplicates(["tile_id"]).repartitionByRange(parts, "offset").sortWithinPartitions("offset").select("offset", "tile")
    pieces = cut(ordered.mapInArrow(write, "offset long, path string")).orderBy("offset").collect()  # a row for each partition

    system, place = _system(root_of(path))
    with system.open_output_stream(f"{place}.part") as out:
        for block in (head, root, meta, *bodies):
            out.write(block)
        for piece in pieces:
            with system.open_input_stream(piece["path"]) as source:
                while block := source.read(16 << 20):
                    out.write(block)
    system.move(f"{place}.part", place)
    if pieces:
        system.delete_dir(_system(root_of(folder))[1])
    return {"tiles": seen[0], "entries": total, "contents": kept}


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _runs(spots: DataFrame) -> DataFrame:
    """Neighbouring tiles of one content as one entry: tile_id, run, length, offset, one. Runs end with their range."""
    parts = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spots.repartitionByRange(parts, "tile_id").sortWithinPartitions("tile_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, offsets = (c.to_numpy() for c in batch.columns)
            new = np.append(True, (ids[1:] != ids[:-1] + 1) | (offsets[1:] != offsets[:-1])) if len(ids) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            runs = np.diff(np.append(at, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids[at], runs, lengths[at], offsets[at], np.ones(len(at), np.int64))], ["tile_id", "run", "length", "offset", "one"])

    return dealt.mapInArrow(run, "tile_id long, run long, length long, offset long, one long")


def _leaf(table: pa.Table) -> pa.Table:
    """One leaf directory; its number is its place divided by the entries of a leaf."""
    table = table.sort_by("tile_id")
    ids, runs, lengths, offsets = (table.column(c).to_numpy() for c in ("tile_id", "run", "length", "offset"))
    return pa.table({"leaf": pa.array([int(ids[0])], pa.int64()), "first": pa.array([int(ids[0])], pa.int64()), "body": pa.array([directory(ids, runs, lengths, offsets)], pa.binary())})


def tile_of(number: int) -> tuple[int, int, int]:
    """(z, x, y) of a tile's number."""
    z = 0
    while number >= 4**z:
        number -= 4**z
        z += 1
    x = y = 0
    for k in range(z):
        side = 1 << k
        rx = 1 & number >> (2 * k + 1)
        ry = 1 & (number >> 2 * k ^ rx)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + side * rx, y + side * ry
    return z, x, y
