"""GeoTIFF files, band 1, as rows (path, row, col, value), read by byte ranges.

Only headers are read first; they give one row for each block (strip or tile) with its place in the file. Blocks are dealt
to tasks by their bytes and read on their own, so a large file is many tasks and a window reads only its blocks. Classic
and big files, plain, deflate or LZW, with or without horizontal differences; other layouts raise.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.raster import Affine

#: Fixed values of the format: tag numbers and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, KIND = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 339
TILE, TILE_ROWS, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SCALE, TIE, NODATA = 33550, 33922, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
PART = 64 << 20  # bytes of blocks that one task reads

Read = Callable[[int, int], bytes]


def header(read: Read | bytes) -> dict:
    """Tags of the first image, by number, and the byte order. ``read(start, size)`` gives bytes of the file."""
    if isinstance(read, bytes):
        data = read
        read = lambda start, size: data[start : start + size]
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("no TIFF")
    big = magic == 43
    wide, entry = ("Q", 20) if big else ("I", 12)
    at = struct.unpack(order + wide, head[8:16] if big else head[4:8])[0]
    size = 8 if big else 2
    count = struct.unpack(order + ("Q" if big else "H"), read(at, size))[0]
    table, tags = read(at + size, entry * count), {"order": order}
    for k in range(count):
        row = table[entry * k : entry * (k + 1)]
        tag, kind = struct.unpack(order + "HH", row[:4])
        (n,) = struct.unpack(order + wide, row[4 : 4 + len(row[4:]) // 2])
        if kind not in FIELDS:
            continue
        own = row[4 + len(row[4:]) // 2 :]
        length = n * struct.calcsize(FIELDS[kind].replace("s", "c"))
        raw = own[:length] if length <= len(own) else read(struct.unpack(order + wide, own)[0], length)
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(f"{order}{n}{FIELDS[kind]}", raw)
    return tags


def affine(tags: dict) -> Affine:
    if SCALE not in tags or TIE not in tags:
        raise ValueError("no pixel scale and tie point")
    (w, h), (i, j, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
    return Affine(w, 0.0, x - i * w, 0.0, -h, y + j * h)


def layout(tags: dict) -> list[tuple[int, int, int, int, int, int]]:
    """(first row, first column, rows, columns, offset, bytes) of each block of band 1; a block may reach over the edge."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(COMPRESSION, 1) not in (1, 5, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only plain, deflate and LZW, without or with horizontal differences")
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    if TILE in tags:
        w, h, offsets, counts = one(TILE, 0), one(TILE_ROWS, 0), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h, offsets, counts = width, min(one(ROWS, height), height), tags[OFFSETS], tags[COUNTS]
    across = -(-width // w)
    total = across * -(-height // h)  # separate planes follow each other: band 1 comes first
    return [(k // across * h, k % across * w, h if TILE in tags else min(h, height - k // across * h), w, offsets[k], counts[k]) for k in range(total)]


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    table, out, width, bits, held, before = [bytes([k]) for k in range(256)] + [b"", b""], [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code == 257:
            break
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before:
            table.append(before + word[:1])
        before = word
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def pixels(raw: bytes, tags: dict, rows: int, cols: int) -> np.ndarray:
    """The rows x cols values of a block's bytes."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    packed, bands = one(COMPRESSION, 1), one(SAMPLES, 1) if one(PLANAR, 1) == 1 else 1
    kind = np.dtype(tags["order"] + {1: "u", 2: "i", 3: "f"}[one(KIND, 1)] + str(one(BITS, 8) // 8))
    data = raw if packed == 1 else unpack_lzw(raw) if packed == 5 else zlib.decompress(raw)
    values = np.frombuffer(data, kind, min(len(data) // kind.itemsize, rows * cols * bands))
    values = values[: len(values) // (cols * bands) * (cols * bands)].reshape(-1, cols, bands)
    if one(PREDICTOR, 1) == 2:
        if kind.kind == "f":
            raise ValueError("horizontal differences of floating-point values are not supported")
        values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
    return values[:, :, 0].astype(np.float64)


def _opened(path: str):
    """A random-access file of a path as Spark writes it."""
    uri = re.sub(r"^file:/+", "file:///", path)
    system, place = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system.open_input_file(place)


def _tags(path: str) -> dict:
    with _opened(path) as file:
        return header(lambda start, size: file.read_at(size, start))


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path")  # the content is not read


def blocks(spark: SparkSession, paths: str | list[str], rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """path, row, col, rows, cols, offset, size of each block that a half-open window needs."""
    names = ["row", "col", "rows", "cols", "offset", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = layout(_tags(path))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), *(pa.array(c, pa.int64()) for c in zip(*found))], ["path", *names])

    made = _files(spark, paths).mapInArrow(run, "path string, " + ", ".join(f"{n} long" for n in names))
    for span, first, size in ((rows, "row", "rows"), (cols, "col", "cols")):
        if span:
            made = made.filter((F.col(first) < span[1]) & (F.col(first) + F.col(size) > span[0]))
    return made


def read(spark: SparkSession, paths: str | list[str], rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, part: int = PART) -> DataFrame:
    """path, row, col, value (null: nodata or NaN) of all pixels, or of half-open ranges of rows and columns. Blocks are dealt
    to tasks of about ``part`` bytes."""
    wanted = blocks(spark, paths, rows, cols)
    total = wanted.agg(F.sum("size")).first()[0] or 0  # headers only
    dealt = wanted.repartition(max(1, -(-total // part)), "path", "offset").sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, tags = None, None, {}
        for batch in batches:
            for path, first, left, high, wide, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != now:
                    if file:
                        file.close()
                    now, file, tags = path, _opened(path), _tags(path)
                text = str(tags.get(NODATA, "")).strip()
                values = pixels(file.read_at(size, offset), tags, high, wide)
                r0, r1 = first, min(first + len(values), tags[HEIGHT][0])
                c0, c1 = left, min(left + wide, tags[WIDTH][0])
                if rows:
                    r0, r1 = max(r0, rows[0]), min(r1, rows[1])
                if cols:
                    c0, c1 = max(c0, cols[0]), min(c1, cols[1])
                values = values[r0 - first : r1 - first, c0 - left : c1 - left].ravel()
                gone = np.isnan(values) | (values == float(text) if text else False)
                n = len(values)
                place = np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(r0 + place // max(1, c1 - c0)), pa.array(c0 + place % max(1, c1 - c0)), pa.array(values, mask=gone)], ["path", "row", "col", "value"])
        if file:
            file.close()

    return dealt.mapInArrow(run, "path string, row long, col long, value double")


def transforms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, height, width and the transform's six numbers of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, _tags(p)) for p in batch.column(0).to_pylist()]
            numbers = [affine(t) for _, t in found]
            columns = [[p for p, _ in found], [t[HEIGHT][0] for _, t in found], [t[WIDTH][0] for _, t in found], *([getattr(n, c) for n in numbers] for c in "abcdef")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 6], strict=True)], ["path", "height", "width", *"abcdef"])

    return _files(spark, paths).mapInArrow(run, "path string, height long, width long, " + ", ".join(f"{c} double" for c in "abcdef"))
