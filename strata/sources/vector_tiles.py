"""Vector tiles: shapes in degrees, clipped to widened web-mercator tiles, on a grid of whole numbers, as protobuf.

Features are clipped and written as drawing commands one by one, in whatever task has them; a tile's task only puts the
finished features of its tile together, with one table of keys and one of values.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators import cells as cl
from ..operators import shapes as sh
from .wkb import nested

EXTENT = 4096
BUFFER = 0.02


def world(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to the unit square of the web-mercator map, y downwards."""
    lat = np.radians(np.clip(y, -cl.LIMIT, cl.LIMIT))
    return (x + 180) / 360, (1 - np.arcsinh(np.tan(lat)) / math.pi) / 2


def clipped(x: np.ndarray, y: np.ndarray, part: np.ndarray, row: np.ndarray, dim: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, part, row) of the corners of parts cut by the box (minx, miny, maxx, maxy) of their row, one side after the other.
    Rings stay one ring each, with edges along the border; lines fall into pieces."""
    for axis, sign in ((0, 1), (2, -1), (1, 1), (3, -1)):
        if not len(x):
            break
        u, v = (x, y) if axis % 2 == 0 else (y, x)
        closed, bound = dim[row] == 2, bounds[row, axis]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        last = np.append(first[1:], len(x)) - 1
        before = np.arange(len(x)) - 1
        before[first] = np.where(closed[first], last, first)
        side = sign * (u - bound)
        here, there = side >= 0, side[before] >= 0
        cross = here != there
        with np.errstate(divide="ignore", invalid="ignore"):
            cut_v = v[before] + side[before] / (side[before] - side) * (v - v[before])
        n = cross.astype(np.int64) + here  # the crossing on the way to a corner, then the corner
        at, k = np.repeat(np.arange(len(x)), n), sh._ramp(n)
        cut = (k == 0) & cross[at]
        u, v = np.where(cut, bound[at], u[at]), np.where(cut, cut_v[at], v[at])
        x, y = (u, v) if axis % 2 == 0 else (v, u)
        again = cut & here[at] & ~closed[at]  # a line comes in once more
        old = part[at]
        part = np.cumsum(np.append(False, old[1:] != old[:-1]) | again) if len(at) else at
        row = row[at]
    return x, y, part, row


def _varints(values: np.ndarray) -> np.ndarray:
    """Bytes of whole numbers below 2 ** 63, seven bits each, and how many each takes."""
    values = values.astype(np.uint64)
    size = 1 + sum((values >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 9))
    at, k = np.repeat(np.arange(len(values)), size), sh._ramp(size)
    seven = (values[at] >> (np.uint64(7) * k.astype(np.uint64))) & np.uint64(127)
    return np.where(k < size[at] - 1, seven | np.uint64(128), seven).astype(np.uint8), size


def _varint(n: int) -> bytes:
    return _varints(np.array([n]))[0].tobytes()


def commands(parts: list[np.ndarray], dim: int) -> bytes:
    """Drawing commands of one feature, from corners on the tile's grid: moves, lines and closings with differences of places,
    signs in the last bit."""
    numbers, cursor = [], np.zeros((1, 2), np.int64)
    if dim == 0:
        parts = [np.concatenate(parts)]
    for p in parts:
        step = np.diff(np.concatenate([cursor, p]), axis=0)
        step = (step << 1) ^ (step >> 63)
        if dim == 0:
            numbers += [1 | len(p) << 3, *step.ravel().tolist()]
        else:
            numbers += [9, *step[0].tolist(), 2 | (len(p) - 1) << 3, *step[1:].ravel().tolist(), *([15] if dim == 2 else [])]
        cursor = p[-1:]
    return _varints(np.array(numbers, np.int64))[0].tobytes()


def _on_grid(xs: np.ndarray, dim: int) -> list[np.ndarray]:
    """The parts of one feature, without repeated corners, degenerate parts and closing corners."""
    out = []
    for p in xs:
        p = p[np.append(True, (p[1:] != p[:-1]).any(axis=1))]
        if dim == 2 and len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        if len(p) >= (1, 2, 3)[dim]:
            out.append(p)
    if dim == 2:  # outer rings first, each with its holes; on a grid whose y grows downwards outer rings turn to the right
        return [r[:-1].astype(np.int64) for polygon in nested([p.astype(np.float64) for p in out]) for r in polygon]
    return out


def tile_features(layer: DataFrame, zoom: int, buffer: float = BUFFER) -> DataFrame:
    """The layer's rows once for each tile (z, x, y) that they reach into, with ``part`` (the clipped shape in tiles from the
    tile's corner), ``kind`` (1 points, 2 lines, 3 polygons) and ``drawing``. Features that vanish on the grid go."""
    layer = sh.shaped(layer)
    shape, dim = (F.coalesce("shape", sh.box_shape()), F.coalesce("dim", sh.box_dim())) if "shape" in layer.columns else (sh.box_shape(), sh.box_dim())
    found = layer.withColumns({"_shape": shape, "_dim": dim}).filter("minx <= maxx and miny <= maxy")
    pad = F.lit(buffer)
    n = 2**zoom

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.greatest(F.floor(low - pad), F.lit(0)), F.least(F.floor(high + pad), F.lit(n - 1)))

    lat = lambda c: F.radians(F.least(F.greatest(F.col(c), F.lit(-cl.LIMIT)), F.lit(cl.LIMIT)))
    down = lambda c: (1 - F.asinh(F.tan(lat(c))) / math.pi) / 2 * n
    found = found.withColumn("x", F.explode(span((F.col("minx") + 180) / 360 * n, (F.col("maxx") + 180) / 360 * n)))
    found = found.withColumn("y", F.explode(span(down("maxy"), down("miny")))).withColumn("z", F.lit(zoom))

    @F.arrow_udf("struct<kind:int,drawing:binary,part:" + sh.SHAPE + ">")
    def draw(shape: pa.Array, dim: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        s = sh.flat(shape, dim)
        part = np.repeat(np.arange(len(shape.flatten())), sh._lengths(shape.flatten()))
        tx, ty = (np.asarray(c.to_numpy(), np.float64) for c in (x, y))
        wx, wy = world(s.x, s.y)
        wx, wy = wx * n - tx[s.corner_row], wy * n - ty[s.corner_row]
        bounds = np.tile([-buffer, -buffer, 1 + buffer, 1 + buffer], (s.rows, 1))
        px, py, part, row = clipped(wx, wy, part, s.corner_row, s.dim, bounds)
        grid = np.round(np.stack([px, py], 1) * EXTENT).astype(np.int64)
        cuts = np.flatnonzero(np.append(False, part[1:] != part[:-1])) if len(part) else []
        pieces, place = np.split(grid, cuts) if len(part) else [], np.split(np.stack([px, py], 1), cuts) if len(part) else []
        owner = row[np.append(0, cuts).astype(np.int64)] if len(part) else np.zeros(0, np.int64)
        ends = np.searchsorted(owner, np.arange(s.rows + 1))
        kinds, drawings, shapes = [], [], []
        for r in range(s.rows):
            own = _on_grid(pieces[ends[r] : ends[r + 1]], int(s.dim[r]))
            kinds.append(int(s.dim[r]) + 1 if own else None)
            drawings.append(commands(own, int(s.dim[r])) if own else None)
            shapes.append([[{"x": a, "y": b} for a, b in p.tolist()] for p in place[ends[r] : ends[r + 1]]])
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.StructArray.from_arrays([pa.array(kinds, pa.int32()), pa.array(drawings, pa.binary()), pa.array(shapes, kind)], ["kind", "drawing", "part"])

    drawn = found.withColumn("_d", draw("_shape", "_dim", "x", "y")).filter("_d.kind is not null")
    return drawn.withColumns({c: F.col("_d")[c] for c in ("kind", "drawing", "part")}).drop("_d", "_shape", "_dim", "shape", "dim")


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _value(v) -> bytes:
    if isinstance(v, bool):
        return b"\x38" + _varint(int(v))
    if isinstance(v, int):
        return b"\x30" + _varint((v << 1) ^ (v >> 63)) if -(1 << 33) < v < 1 << 33 else b"\x19" + struct.pack("<d", float(v))
    if isinstance(v, float):
        return b"\x19" + struct.pack("<d", v)
    return _field(1, str(v).encode())


def tiles(layer: DataFrame, zooms: list[int], columns: list[str], name: str = "layer", buffer: float = BUFFER) -> DataFrame:
    """z, x, y, tile: protobuf of each tile that holds a feature, with the named columns as attributes (nulls and NaN are
    left out). Rows come to their tile sorted and drawn, so its task holds no more than the tile itself."""
    found = None
    for z in zooms:
        one = tile_features(layer, z, buffer).select("z", "x", "y", "id", "kind", "drawing", *columns)
        found = one if found is None else found.unionByName(one)
    whole = found.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "id")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, features, values = None, [], {}

        def tile() -> pa.RecordBatch:
            keys = b"".join(_field(3, c.encode()) for c in columns)
            body = b"\x78\x02" + _field(1, name.encode()) + b"".join(features) + keys + b"".join(_field(4, v) for v in values) + b"\x28" + _varint(EXTENT)
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(now, (pa.int32(), pa.int64(), pa.int64()))), pa.array([_field(3, body)], pa.binary())], ["z", "x", "y", "tile"])

        for batch in batches:
            for z, x, y, _, kind, drawing, *given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (z, x, y) != now:
                    if now:
                        yield tile()
                    now, features, values = (z, x, y), [], {}
                tags = b"".join(_varint(k) + _varint(values.setdefault(_value(v), len(values))) for k, v in enumerate(given) if v is not None and v == v)
                features.append(_field(2, (_field(2, tags) if tags else b"") + b"\x18" + _varint(kind) + _field(4, drawing)))
        if now:
            yield tile()

    return whole.mapInArrow(put, "z int, x long, y long, tile binary")


def write_tiles(made: DataFrame, folder: str) -> DataFrame:
    """Files {z}/{x}/{y}.pbf; returns z, x, y, bytes of each. A file is written under a name of its own and then moved."""
    root = re.sub(r"^file:/+", "file:///", folder.rstrip("/"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            sizes = []
            for z, x, y, tile in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system.create_dir(f"{base}/{z}/{x}", recursive=True)
                spare = f"{base}/{z}/{x}/.{y}-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(spare) as out:
                    out.write(tile)
                system.move(spare, f"{base}/{z}/{x}/{y}.pbf")
                sizes.append(len(tile))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], ["z", "x", "y", "bytes"])

    schema = T.StructType([T.StructField("z", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("x", "y", "bytes"))])
    return made.select("z", "x", "y", "tile").mapInArrow(write, schema)
