"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot; shard files hold
fixed-stride records in slot order, and a reader resumes at any slot."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from .common import brief_shuffles, discard, files, portions, remove, scratch, stored
from .tokens import default_path, encoder

ROUNDS = 4


def permute(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A bijection of 0..size-1: a balanced Feistel network on the next even number of bits, walked along its cycles
    until the value is below ``size``."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            f = (right + np.uint64((key * 2 + 1 + r * 0x632BE59BD9B4E019) & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(32)) & mask
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (far := out >= np.uint64(size)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def mark() -> Column:
    """The number by which documents are ordered before the permutation."""
    return F.xxhash64("doc_id", "text")


def _name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def write_shards(docs: DataFrame, length: int = 512, per_shard: int = 4096, key: int = 2024, path: str | None = None, end_id: int = 1) -> tuple[str, DataFrame]:
    """The folder of the shard files, and their index (slot, doc_id, chunk, n_tokens), stored as a table.

    A document (null text: empty) is its ids and the end id, cut every ``length``. Sequences are numbered in the order of
    ``mark`` and doc_id, so their slots follow from the rows and the key, not from how the table is split; rows that are
    alike are interchangeable. Each task writes one shard under another name and renames it when it is whole, so a
    repeated task does no harm. Shards are written in ``ROUNDS`` rounds: each exchanges only the records of its own shards,
    and its shuffle files go before the next one. Slot s is in file s // per_shard at byte (s % per_shard) * 2 * length: ``length`` 16-bit
    ids, padded with 0.

    Every row counts, null and repeated ids and repeated rows included; texts are never cut short; an empty table gives no
    shards; other columns are ignored. Vocabularies of more than 65,536 ids raise.
    """
    spark = docs.sparkSession
    where = path or default_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    folder = f"{scratch(spark)}/order-shards-{uuid.uuid4().hex}"
    store, inside = files(folder)
    store.create_dir(inside)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(where)
        if coder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        for part in portions(batches, "text"):
            rows = []
            for doc, at, found in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), coder.encode(part.column(1)), strict=True):
                ids = np.append(found, end_id).astype("<u2")
                count = -(-len(ids) // length)
                for k in range(count):
                    piece = ids[k * length : (k + 1) * length]
                    rows.append((doc, k, len(piece), piece.tobytes(), at, count))
            kinds = (part.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "chunk", "n_tokens", "ids", "mark", "chunks"])

    pieces = docs.select("doc_id", "text", mark().alias("mark")).mapInArrow(chunks, f"doc_id {id_type}, chunk long, n_tokens long, ids binary, mark long, chunks long")
    made = stored(pieces.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "order-records")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sequences that stand before each document in its range."""
        before = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            sums = np.cumsum(n) + before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - n)], ["part", "place", "chunks", "range", "before"])
            before = int(sums[-1]) if len(sums) else before

    # documents are ordered without their records, a few numbers each; the numbers go back to where the records are
    order, parts = ["mark", "doc_id"], max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = made.filter("chunk = 0").select(*order, "part", "place", "chunks")
    ranges = heads.repartitionByRange(parts, *order).sortWithinPartitions(*order, "part", "place").withColumn("range", F.spark_partition_id())
    laid = stored(ranges.select("part", "place", "chunks", "range").mapInArrow(summed, "part int, place long, chunks long, range int, before long"), "order-places")
    total, base = 0, {}  # a row for each range
    for r in laid.groupBy("range").agg(F.sum("chunks").alias("n")).orderBy("range").collect():
        base[r["range"]] = total
        total += int(r["n"])
    rows = spark.createDataFrame(list(base.items()), "range int, head long")
    places = f"{scratch(spark)}/order-numbers-{uuid.uuid4().hex}"
    laid.join(F.broadcast(rows), "range").select("part", "place", (F.col("head") + F.col("before")).alias("number")).repartition("part").write.partitionBy("part").parquet(places)
    discard(laid)

    def slots(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        """The records with slots from ``low`` up to ``high``: each part of the records has a folder with the numbers of
        its documents."""
        store, inside = files(places)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            part, first = batch.column(6).to_numpy(), batch.column(7).to_numpy() - batch.column(1).to_numpy()
            index = np.zeros(len(part), np.int64)
            for p in np.unique(part):
                if p not in known:
                    found = pq.read_table(f"{inside}/part={p}", filesystem=store, columns=["place", "number"])
                    by = np.argsort(found.column("place").to_numpy())
                    known = {p: (found.column("place").to_numpy()[by], found.column("number").to_numpy()[by])}
                at = part == p
                index[at] = known[p][1][np.searchsorted(known[p][0], first[at])]
            slot = permute(index + batch.column(1).to_numpy(), total, key)
            placed = pa.RecordBatch.from_arrays([pa.array(slot), *batch.columns[:4]], ["slot", "doc_id", "chunk", "n_tokens", "ids"])
            yield placed.filter(pa.array((slot >= low) & (slot < high)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = files(folder)
        shard, out, name = -1, None, ""

        def close() -> None:
            out.close()
            if store.get_file_info(_name(inside, shard)).type.name == "NotFound":
                store.move(name, _name(inside, shard))
            else:  # another try of this task was first; the bytes are the same
                store.delete_file(name)

        try:
            for batch in batches:
                for slot, ids in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    if slot // per_shard != shard:
                        if out:
                            close()
                        shard, name = slot // per_shard, f"{inside}/.{uuid.uuid4().hex}"
                        out = store.open_output_stream(name)
                    if out.tell() != slot % per_shard * 2 * length:
                        raise ValueError(f"slot {slot} is out of order")
                    out.write(ids.ljust(2 * length, b"\0"))
                yield pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4])
            if out:
                close()
                name = ""
        finally:
            if name and store.get_file_info(name).type.name != "NotFound":
                out.close()
                store.delete_file(name)

    shards = max(1, -(-total // per_shard))
    written = f"{scratch(spark)}/order-index-{uuid.uuid4().hex}"
    fields = f"slot long, doc_id {id_type}, chunk long, n_tokens long"
    cuts = [shards * k // ROUNDS for k in range(ROUNDS + 1)]
    with brief_shuffles(spark):
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            placed = made.mapInArrow(partial(slots, low=low * per_shard, high=high * per_shard), f"{fields}, ids binary")
            # slots are dense, so the bounds of the ranges are known and need no sampling pass
            dealt = placed.repartitionById(high - low, (F.floor(F.col("slot") / per_shard) - low).cast("int")).sortWithinPartitions("slot")
            dealt.mapInArrow(write, fields).write.mode("append").option("compression", "zstd").parquet(written)
    index = spark.read.schema(fields).parquet(written)
    discard(made)
    remove(spark, places)
    return folder, index


def read_slots(folder: str, index: DataFrame, length: int = 512, per_shard: int = 4096) -> DataFrame:
    """slot, shard, byte_offset, doc_id, chunk, n_tokens, record of the rows of an index, the record read from its shard."""
    stride = 2 * length
    id_type = index.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = files(folder)
        for batch in batches:
            slots = batch.column(0).to_numpy()
            shard, place = slots // per_shard, slots % per_shard * stride
            starts = np.flatnonzero(np.append(True, (np.diff(slots) != 1) | (np.diff(shard) != 0))) if len(slots) else []
            for i, j in zip(starts, [*starts[1:], len(slots)], strict=True):
                with store.open_input_file(_name(inside, shard[i])) as file:
                    file.seek(int(place[i]))
                    data = file.read(int(j - i) * stride)
                if len(data) != (j - i) * stride:
                    raise ValueError(f"shard {shard[i]} ends before slot {slots[j - 1]}")
                records = pa.Array.from_buffers(pa.binary(), int(j - i), [None, pa.py_buffer(np.arange(j - i + 1, dtype=np.int32) * np.int32(stride)), pa.py_buffer(data)])
                rest = [c.slice(i, j - i) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([rest[0], pa.array(shard[i:j]), pa.array(place[i:j]), *rest[1:], records], ["slot", "shard", "byte_offset", "doc_id", "chunk", "n_tokens", "record"])

    return index.select("slot", "doc_id", "chunk", "n_tokens").mapInArrow(read, f"slot long, shard long, byte_offset long, doc_id {id_type}, chunk long, n_tokens long, record binary")


def resume(folder: str, slot: int = 0, length: int = 512, per_shard: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """Slots and their ids from ``slot`` on, read in order from the shard files alone."""
    store, inside = files(folder)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(inside)) if f.base_name.startswith("shard-")]
    last = max((int(n[6:-4]) for n in names), default=-1)
    for shard in range(slot // per_shard, last + 1):
        with store.open_input_file(_name(inside, shard)) as file:
            file.seek(slot % per_shard * 2 * length)
            while data := file.read(2 * length):
                yield slot, np.frombuffer(data, "<u2")
                slot += 1
        if slot != (shard + 1) * per_shard and shard != last:
            raise ValueError(f"shard {shard} ends before slot {(shard + 1) * per_shard}")


def materialise(docs: DataFrame, length: int = 512, per_shard: int = 4096, key: int = 2024, path: str | None = None, end_id: int = 1) -> DataFrame:
    """slot, shard, byte_offset, doc_id, chunk, n_tokens and record: what ``write_shards`` wrote, read back from the files."""
    folder, index = write_shards(docs, length, per_shard, key, path, end_id)
    return read_slots(folder, index, length, per_shard)
