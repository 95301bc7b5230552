"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source_size copies. Within a source the documents stand in the order of
their size (then a hash), the expected copies are summed up along that order, one offset per source is added, and a
document is taken once for each whole number that the sum crosses. Along sizes, the words taken follow the target to
within about the largest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, stored

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source: by repeating weights over the sources by code point, null last; at most ``cap``
    times a source's size, the excess going to the others by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each source within a partition that is sorted by source."""
    last, count = object(), 0
    for batch in batches:
        ranks = []
        for source in batch.column(batch.schema.names.index("source")).to_pylist():
            count = count + 1 if source == last else 1
            last = source
            ranks.append(count)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], [*batch.schema.names, "rank"])


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words), source_size, target (words wanted of its source) and copies.

    Null texts have size 0, the null source is a source. Sources without words have target 0 and no copies. Repeated
    rows count each. The order is dealt out by range, so a hot source spreads over many tasks; the driver sees one row
    per source only. The same input gives the same copies. Columns in ``carry`` (longs) stay with their rows.
    """
    spark = docs.sparkSession
    narrow = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *carry), "mix-sizes")
    sizes = {r["source"]: int(r["n"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    wanted = targets(sizes, weights, share, cap)
    rows = [(s, sizes[s], float(wanted[s]), (zlib.crc32(f"{seed}:{s}".encode()) % 1024) / 1024) for s in sizes]
    plan = spark.createDataFrame(rows, f"source {docs.schema['source'].dataType.simpleString()}, source_size long, target double, offset double")

    key = ["source", "size", "h", "doc_id", *carry]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = narrow.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).select("doc_id", "source", "size", "h", *carry).repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source {docs.schema['source'].dataType.simpleString()}, size long, h long, {''.join(f'{c} long, ' for c in carry)}part int, rank long"
    ranked = stored(ordered.mapInArrow(_ranks, schema), "mix-ranks")
    counts = ranked.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = counts.select("source", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    heads = before.join(plan, before["source"].eqNullSafe(plan["source"])).select(before["source"].alias("s"), F.col("part").alias("p"), "before", "source_size", "target", "offset")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    end = F.floor(ratio * (F.col("before") + F.col("rank")) + F.col("offset"))
    begin = F.floor(ratio * (F.col("before") + F.col("rank") - 1) + F.col("offset"))
    joined = ranked.join(heads, ranked["source"].eqNullSafe(heads["s"]) & (ranked["part"] == heads["p"]))
    mixed = stored(joined.select("doc_id", "source", "size", "source_size", "target", (end - begin).cast("long").alias("copies"), *carry), "mixed")
    discard(narrow, ranked)
    return mixed
