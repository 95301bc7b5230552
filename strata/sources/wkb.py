"""Well-known binary to shapes and back, and Parquet files with geometry metadata.

Reading takes both byte orders, Z and M (dropped), SRIDs and nested collections, of which the parts of the highest dimension
stay. Writing nests rings: a ring in an odd number of others is a hole of the smallest one around it."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators import cells as cl
from ..operators import shapes as sh

_GEOMETRY = T.StructType([T.StructField("shape", T.ArrayType(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"])))), T.StructField("dim", T.IntegerType())])
#: Fixed values of the format: geometry types.
POINT, LINE, POLYGON, POINTS, LINES, POLYGONS, COLLECTION = range(1, 8)


def _read(data: bytes, at: int) -> tuple[list[tuple[int, np.ndarray]], int]:
    """(dimension, corners) of the parts of one geometry, and where it ends."""
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    extra = ((kind >> 31) & 1) + ((kind >> 30) & 1)
    at += 4 * ((kind >> 29) & 1)
    kind &= 0x0FFFFFFF
    extra += {0: 0, 1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)
    kind, width = kind % 1000, 2 + extra

    def corners(at: int, n: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2].astype(np.float64), at + 8 * n * width

    if kind == POINT:
        point, at = corners(at, 1)
        return ([] if np.isnan(point).any() else [(0, point)]), at
    if kind not in range(LINE, COLLECTION + 1):
        raise ValueError(f"geometry type {kind} is not supported")
    (n,), at, out = struct.unpack_from(order + "I", data, at), at + 4, []
    if kind == LINE:
        line, at = corners(at, n)
        return ([(1, line)] if n else []), at
    for _ in range(n):
        if kind == POLYGON:
            (m,) = struct.unpack_from(order + "I", data, at)
            ring, at = corners(at + 4, m)
            if m:
                out.append((2, ring))
        else:
            parts, at = _read(data, at)
            out += parts
    return out, at


def decode(data: bytes | None) -> tuple[int, list[np.ndarray]] | None:
    """(dimension, parts) of the highest dimension; None for null and empty geometries."""
    if not data:
        return None
    parts, _ = _read(bytes(data), 0)
    if not parts:
        return None
    dim = max(d for d, _ in parts)
    return dim, [p for d, p in parts if d == dim]


@F.arrow_udf(_GEOMETRY)
def from_wkb(column: pa.Array) -> pa.Array:
    """struct(shape, dim); both null for null and empty geometries."""
    found = [decode(v) for v in column.to_pylist()]
    parts = [p for f in found if f for p in f[1]]
    corners = np.concatenate([*parts, np.zeros((0, 2))])
    gone = pa.array([f is None for f in found])
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])), pa.int32()), pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], ["x", "y"]))
    shape = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f[1]) if f else 0 for f in found])), pa.int32()), inner, mask=gone)
    return pa.StructArray.from_arrays([shape, pa.array([f[0] if f else None for f in found], pa.int32())], ["shape", "dim"])


def nested(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons (outer ring first, then its holes) of rings that fill by the even-odd rule; closed, outer rings to the left."""
    if not rings:
        return []
    rings = [r if (r[0] == r[-1]).all() else np.concatenate([r, r[:1]]) for r in rings]
    signed = np.array([((r[:-1, 0] - r[0, 0]) * (r[1:, 1] - r[0, 1]) - (r[1:, 0] - r[0, 0]) * (r[:-1, 1] - r[0, 1])).sum() / 2 for r in rings])
    holds = np.zeros((len(rings), len(rings)), bool)
    if len(rings) > 1:
        middle = np.array([(r[0] + r[1]) / 2 for r in rings])
        for k, r in enumerate(rings):
            x0, y0, x1, y1 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                below = ((x0 > middle[:, :1]) != (x1 > middle[:, :1])) & (y0 + (y1 - y0) * ((middle[:, :1] - x0) / (x1 - x0)) < middle[:, 1:])
            holds[k] = (below.sum(1) % 2 == 1) & (np.abs(signed) < abs(signed[k]))
    depth = holds.sum(0)
    outer = {k: [] for k in range(len(rings)) if depth[k] % 2 == 0}
    for k in np.flatnonzero(depth % 2 == 1):
        around = [j for j in outer if holds[j, k]]
        outer[min(around, key=lambda j: abs(signed[j]))].append(k)
    turned = lambda k, left: rings[k] if (signed[k] > 0) == left else rings[k][::-1]
    return [[turned(k, True), *(turned(h, False) for h in holes)] for k, holes in outer.items()]


def encode(dim: int, parts: list[np.ndarray]) -> bytes:
    """Little-endian well-known binary; several parts become a multi geometry."""
    head = lambda kind, n=None: struct.pack("<BI", 1, kind) + (b"" if n is None else struct.pack("<I", n))
    corners = lambda p: struct.pack("<I", len(p)) + np.ascontiguousarray(p, "<f8").tobytes()
    if dim == 2:
        each = [head(POLYGON, len(rings)) + b"".join(map(corners, rings)) for rings in nested(parts)]
    elif dim == 1:
        each = [head(LINE) + corners(p) for p in parts]
    else:
        each = [head(POINT) + np.ascontiguousarray(p, "<f8").tobytes() for part in parts for p in part.reshape(-1, 1, 2)]
    return each[0] if len(each) == 1 else head((POINTS, LINES, POLYGONS)[dim], len(each)) + b"".join(each)


@F.arrow_udf(T.BinaryType())
def to_wkb(shape: pa.Array, dim: pa.Array) -> pa.Array:
    """Well-known binary of shapes; null for null ones and those without corners."""
    parts = shape.flatten()
    corners = parts.flatten()
    xy = np.stack([np.asarray(corners.field(c).to_numpy(zero_copy_only=False), np.float64) for c in "xy"], 1)
    pieces = np.split(xy, np.cumsum(sh._lengths(parts))[:-1]) if len(parts) else []
    out, at = [], 0
    for n, d in zip(sh._lengths(shape).tolist(), dim.to_pylist(), strict=True):
        own = [p for p in pieces[at : at + n] if len(p)]
        at += n
        out.append(encode(d, own) if own else None)
    return pa.array(out, pa.binary())


def decoded(layer: DataFrame, column: str = "geometry") -> DataFrame:
    """The layer with shape, dim and bounds in place of a binary column; rows without a geometry go."""
    found = layer.withColumn("_g", from_wkb(column)).drop(column).withColumns({"shape": F.col("_g.shape"), "dim": F.col("_g.dim")}).drop("_g").filter("shape is not null")
    each = lambda c: F.flatten(F.transform("shape", lambda part: F.transform(part, lambda p: p[c])))
    return found.withColumns({f"{side}{c}": f(each(c)) for side, f in (("min", F.array_min), ("max", F.array_max)) for c in "xy"})


def encoded(layer: DataFrame, column: str = "geometry") -> DataFrame:
    """The layer with a binary column in place of its shape; boxes become polygons, lines or points."""
    layer = sh.shaped(layer)
    shape, dim = (F.coalesce("shape", sh.box_shape()), F.coalesce("dim", sh.box_dim())) if "shape" in layer.columns else (sh.box_shape(), sh.box_dim())
    return layer.withColumn(column, to_wkb(shape, dim)).drop("shape", "dim")


def write_geoparquet(layer: DataFrame, folder: str, by: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """One or more Parquet files with geometry metadata in a folder {by}={value} for each value; returns by, path, rows.

    A file holds about ``rows_per_file`` rows, so a large group is many tasks. Each file is written under a name of its own
    and moved to its place when it is whole: a task that runs again leaves the same files.
    """
    made = encoded(layer)
    counts = made.groupBy(by).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    dealt = made.join(counts, made[by].eqNullSafe(counts[by])).drop(counts[by]).withColumn("_salt", F.pmod(F.xxhash64("id", *[c for c in ("minx", "miny", "maxx", "maxy")]), F.col("_files"))).drop("_files")
    root = re.sub(r"^file:/+", "file:///", folder.rstrip("/"))
    geo = json.dumps({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": []}}}).encode()
    text = T.StructType([T.StructField(by, T.StringType()), T.StructField("path", T.StringType()), T.StructField("rows", T.LongType())])

    def write(table: pa.Table) -> pa.Table:
        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        value, salt = (table.column(c)[0].as_py() for c in (by, "_salt"))
        place = f"{base}/{by}={value}"
        system.create_dir(place, recursive=True)
        from pyspark import TaskContext

        spare, path = f"{place}/.{salt}-{TaskContext.get().taskAttemptId()}", f"{place}/part-{salt:05d}.parquet"
        body = table.drop_columns([by, "_salt"])
        pq.write_table(body.replace_schema_metadata({b"geo": geo}), spare, filesystem=system)
        system.move(spare, path)
        return pa.table({by: pa.array([str(value)]), "path": pa.array([path]), "rows": pa.array([len(table)], pa.int64())})

    return dealt.groupBy(by, "_salt").applyInArrow(write, text)


def write_cell_tiles(cells: DataFrame, folder: str, level: int = 5, rows_per_file: int = 1_000_000) -> DataFrame:
    """Cells with their squares as geometry, a folder for each ancestor tile."""
    layer = cl.boxes(cl.partition_by_ancestor(cells, level).withColumn("_cell", F.col("cell")), "_cell")
    return write_geoparquet(layer, folder, "tile", rows_per_file)
