"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, portions

UNIT = 192  # 8 x 8 pixels of three samples


def encode_ppm(image: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom up, each padded to four bytes."""
    h, w = image.shape[:2]
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    number = lambda x, n=4: int(x).to_bytes(n, "little")
    info = number(40) + number(w) + number(h) + number(1, 2) + number(24, 2) + number(0) + number(rows.size) + number(2835) * 2 + number(0) * 2
    return b"BM" + number(54 + rows.size) + number(0) + number(54) + info + rows.tobytes()


def _bmp(data: bytes) -> np.ndarray | None:
    """Plain BMP of 24 or 32 bits a pixel, or of 8 with a palette."""
    at, info, w, h = (int.from_bytes(data[k : k + 4], "little", signed=True) for k in (10, 14, 18, 22))
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if bits not in (8, 24, 32) or packed not in (0, 3 if bits == 32 else 0) or w <= 0 or h == 0:
        return None
    n, stride = bits // 8, (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * n]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = int.from_bytes(data[46:50], "little") or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:colours] = np.frombuffer(data, np.uint8, 4 * colours, 14 + info).reshape(colours, 4)[:, 2::-1]
        return palette[rows]
    return rows.reshape(abs(h), w, n)[:, :, 2::-1]


def _netpbm(data: bytes) -> np.ndarray | None:
    """P1 to P6, with comments between the numbers of the head; samples are scaled to 255."""
    space = rb"(?:\s|#[^\n]*\n)+"
    bitmap = data[1:2] in (b"1", b"4")
    head = re.match(rb"P[1-6]" + space + rb"(\d+)" + space + rb"(\d+)" + (b"" if bitmap else space + rb"(\d+)") + rb"\s", data)
    if not head:
        return None
    kind, w, h, top = int(data[1:2]), int(head[1]), int(head[2]), 1 if bitmap else int(head[3])
    channels, body = 3 if kind in (3, 6) else 1, data[head.end() :]
    count = w * h * channels
    if not 0 < top < 1 << 16:
        return None
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(body, np.uint8, h * ((w + 7) // 8)).reshape(h, -1), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    if kind == 1:
        flat = 1 - np.frombuffer(re.sub(rb"#[^\n]*\n|[^01]", b"", body), np.uint8)[:count].astype(np.int64) + 48
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", body).split()[:count], np.int64)
    else:
        flat = np.frombuffer(body, np.uint8 if top < 256 else ">u2", count)
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape(h, w, channels)


def decode(data: bytes | None) -> np.ndarray | None:
    """Height x width x channels of uint8; None for null, empty or broken data and other formats."""
    try:
        return None if not data else _bmp(data) if data[:2] == b"BM" else _netpbm(data)
    except (ValueError, TypeError, IndexError):
        return None


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target pixel's area, exact at fractional borders, from the integral image; black without pixels."""
    if not image.size:
        return np.zeros((height, width, *image.shape[2:]))
    grey = image.astype(np.float64)
    h, w = grey.shape[:2]
    total = np.zeros((h + 1, w + 1, *grey.shape[2:]))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def along(table: np.ndarray, axis: int, size: int, goal: int) -> np.ndarray:
        at = np.arange(goal + 1) * size / goal
        low = np.minimum(at.astype(np.int64), size - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(table.ndim)])
        edge = table.take(low, axis) * (1 - part) + table.take(low + 1, axis) * part
        return np.diff(edge, axis=axis)

    return along(along(total, 0, h, height), 1, w, width) / ((h / height) * (w / width))


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 neighbours along a row of the grey 8 x 9 image grows."""
    small = area_resize(image.mean(axis=2), 8, 9)
    return int("".join("1" if x else "0" for x in (np.diff(np.round(small, 6), axis=1) > 0).ravel()), 2)


def media_row(text: bytes, tile: int = 16) -> dict:
    """Stores one payload as an image, reads it back and computes what the table has of it."""
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    image = np.frombuffer(payload, np.uint8).reshape(-1, 8, 3)
    media = (encode_bmp if len(payload) // UNIT % 2 else encode_ppm)(image)
    back = decode(media)
    read = back.tobytes()
    return {
        "n_bytes": len(text), "payload_bytes": len(read), "payload_sha256": hashlib.sha256(read).hexdigest(), "tail_crc32": zlib.crc32(read[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"{difference_hash(back):016x}",
        "tile": npy(np.clip(np.round(area_resize(back, tile, tile)), 0, 255).astype(np.uint8)), "media": media,
    }


FIELDS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "tile": "binary", "media": "binary"}
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def media_table(docs: DataFrame, columns: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """doc_id and ``columns``: each whole text as an image (BMP or PPM by its number of units), read back, with an NPY
    tile and a difference hash. Null texts count as empty ones (one unit of spaces); repeated rows each give a row; an
    empty table gives none; other columns are ignored. Row by row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            raw, at = buffers(batch.column(1))
            data = raw.tobytes()
            rows = [media_row(data[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], ARROW[FIELDS[c]]) for c in columns)], ["doc_id", *columns])

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {FIELDS[c]}" for c in columns)])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def media_columns(images: DataFrame, column: str = "media", tile: int = 16) -> DataFrame:
    """Adds height, width, channels, tile (NPY of the image resized to ``tile`` x ``tile``) and feature (difference hash) of
    a column of binary images. Null where the image is null, broken or of another format; all rows and columns stay, and
    columns of these names are replaced."""
    new = {"height": "int", "width": "int", "channels": "int", "tile": "binary", "feature": "string"}
    kept = [c for c in images.columns if c not in new]
    kinds = {"int": pa.int32(), **ARROW}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column):
            found = []
            for data in batch.column(batch.schema.get_field_index(column)).to_pylist():
                image = decode(data)
                found.append([None] * 5 if image is None else [*image.shape, npy(np.clip(np.round(area_resize(image, tile, tile)), 0, 255).astype(np.uint8)), f"{difference_hash(image):016x}"])
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kinds[t]) for c, t in zip(columns, new.values()))], [*kept, *new])

    narrow = images.select(*kept)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields]
    return narrow.mapInArrow(run, ", ".join([*fields, *(f"{c} {t}" for c, t in new.items())]))
