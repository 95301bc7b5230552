"""Packing documents into sequences along a Hilbert curve.

A document's tokens are hashed into a vector and projected to three dimensions; its place on the Hilbert curve through
their cube is the sort key. The ordered token stream is cut every ``length`` tokens, so only the last sequence is padded.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, portions, stored
from .tokens import default_path, encoder

DIMS, BITS = 3, 10
CELLS = 15  # bits of a key by which ranges are planned
RANGE = 8_000_000  # tokens of a range


def hilbert(point: list[int], bits: int = BITS) -> int:
    """Index along the Hilbert curve of a point with ``bits`` bits a coordinate (Skilling's transform)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


@functools.cache
def signs(size: int) -> np.ndarray:
    """A random sign for each dimension and id below ``size``."""
    ids, rows = np.arange(1, size + 1, dtype=np.uint64), []
    for d in range(DIMS):
        mixed = ids * np.uint64((0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 * d) & (2**64 - 1) | 1)
        rows.append(((mixed >> np.uint64(61)) & np.uint64(1)).astype(np.int8) * 2 - 1)
    return np.stack(rows).astype(np.int8)


def curve_keys(ids: np.ndarray, starts: np.ndarray) -> list[int]:
    """Projects the hashed token counts of documents (none empty) by random signs and scales each dimension to its cell. Ids have 16 bits."""
    root = np.sqrt(np.diff(np.append(starts, len(ids))))
    values = np.stack([np.add.reduceat(row[ids], starts, dtype=np.int64) / root for row in signs(1 << 16)])
    cells = np.clip((np.tanh(values / 8) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return [hilbert(cell) for cell in cells.T.tolist()]


def tokenised(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, key, n, ids (16-bit ids as bytes, the end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        if coder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        for batch in batches:
            for part in portions(iter([batch]), "text"):
                each = [np.append(x, end_id).astype("<u2") for x in coder.encode(part.column(1))]
                counts = np.array([len(x) for x in each], np.int64)
                keys = curve_keys(np.concatenate(each), np.cumsum(counts) - counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.int64()), pa.array(counts), pa.array([x.tobytes() for x in each], pa.binary())], ["doc_id", "key", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n long, ids binary")


def ranged(keyed: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Adds ``part``, the number of the range along the curve that a row belongs to; second, how many there are. Ranges hold about equal numbers of
    tokens: the tokens of each cell of the curve (at most 2 ** CELLS rows on the driver) are summed up along it; a cell with
    more than a range's tokens, of many copies for instance, is cut by a hash of the id."""
    cell = F.shiftright("key", DIMS * BITS - CELLS)
    rows = keyed.groupBy(cell.cast("int").alias("cell")).agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    counts = rows["n"].to_numpy(np.int64)
    total = int(counts.sum())
    goal = max(1, -(-total // max(parts, -(-total // RANGE))))
    pieces = np.maximum(1, counts // goal)
    wide = pieces > 1
    fill, part, low = 0, -1, np.zeros(len(counts), np.int64)
    for k in range(len(counts)):  # cells in order: each starts a new range when the last one is full
        if part < 0 or wide[k] or wide[k - 1] or fill + counts[k] > goal:
            part, fill = part + 1, 0
        low[k], fill = part, fill + counts[k]
        part += int(pieces[k]) - 1
    spark = keyed.sparkSession
    plan = spark.createDataFrame([(int(c), int(i), int(w)) for c, i, w in zip(rows["cell"], low, pieces)], "_cell int, _low int, _pieces int")
    at = (F.col("_low") + F.pmod(F.shiftright("h", 20), F.col("_pieces"))).cast("int")
    return keyed.withColumn("_cell", cell.cast("int")).join(F.broadcast(plan), "_cell").withColumn("part", at).drop("_cell", "_low", "_pieces"), part + 1


def pack(docs: DataFrame, length: int = 2048, path: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (bytes of 32-bit ids).

    Null and empty texts give one piece with the end id. Repeated rows are packed each. An empty table gives no piece.
    Equal keys are ordered by a hash of the id, so large groups of copies spread over the ranges. Other columns are
    ignored; null ids are packed like others.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ready = stored(tokenised(docs, path or default_path()), "pack-ids")
    order = ["key", "h", "doc_id"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the tokens that stand before each row in its range."""
        before = 0
        for batch in batches:
            sums = np.cumsum(batch.column(1).to_numpy()) + before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - batch.column(1).to_numpy())], ["doc_id", "n", "ids", "part", "place"])
            before = int(sums[-1]) if len(sums) else before

    # the id stands for rows; a part of the digest keeps rows of one id apart and null ids from one range
    dealt, count = ranged(ready.withColumn("h", F.xxhash64("doc_id", F.crc32("ids"))), parts)
    ranges = dealt.repartitionById(max(1, count), F.col("part")).sortWithinPartitions(*order)
    laid = stored(ranges.select("doc_id", "n", "ids", "part").mapInArrow(placed, f"doc_id {id_type}, n long, ids binary, part int, place long"), "pack-order")
    discard(ready)
    totals = laid.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition
    heads = {r["part"]: int(r["before"]) for r in totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, ids, part, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, wide, start = heads[part] + place, np.frombuffer(ids, "<u2").astype("<u4"), 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = wide[start : start + size].tobytes()
                    rows.append((doc, start, size, zlib.crc32(piece), n, at // length, at % length, piece))
                    start, at = start + size, at + size
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type if k == 0 else pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return laid.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
