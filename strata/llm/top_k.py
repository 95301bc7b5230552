"""Exact top-k inner products by norm buckets.

Vectors are sorted by length; runs of like length are buckets. From a query's lower bound (its k-th score among the longest
vectors, then its k-th best so far) each bucket gets a local cosine threshold: over 1 the query does not go there; high
thresholds prune by the feasible ranges of the query's largest coordinates, others by length. What is left is verified by
exact products. Queries go round in blocks of bounded size: a task reads its candidates once a block and keeps the best of
them, so vectors are exchanged once, when they are sorted, and only the lists of k are merged.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, remove, scratch, stored
from .hard_negatives import FIELDS, _matrix, _scan

SEED_ROWS = 2048
SLICE = 256  # queries whose products with the seeds are held at once


def whole(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (floor of ``scale`` times each component), width, norm; vectors without id, and those that are null or hold
    null or non-finite components, go."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    kept = vectors.filter("vec_id is not null and embedding is not null").filter(sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumns({"width": F.size("v"), "norm": norm})


def _bounds(q: np.ndarray, own: np.ndarray, seed: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the seeds but its own row; -inf if there are fewer."""
    out = np.full(len(q), -np.inf)
    if len(rows) >= k:
        for low in range(0, len(q), SLICE):
            scores = q[low : low + SLICE] @ seed.T
            scores[own[low : low + SLICE, None] == rows] = -np.inf
            out[low : low + SLICE] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose id is divisible by ``every``, candidates all other rows.

    Rows without id, null vectors and those with null or non-finite components take no part; vectors meet those of their
    own width. Equal scores go to the smaller id. Rows that share a vec_id are rows of their own: each query row has its
    list, and each may stand in the lists of all others. An empty table gives none; other columns are ignored. Scores are
    exact while they stay below 2 ** 53. About ``block`` queries are held at once, by the driver and by each task.
    """
    spark = vectors.sparkSession
    order = ["width", F.desc("norm"), "vec_id"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = whole(vectors).withColumn("label", F.lit(0).cast("long")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    base = stored(dealt.withColumn("row", F.monotonically_increasing_id()), "vectors")  # kept as written, so rows stay what they are
    seeds = base.orderBy(F.desc("norm"), "row").limit(SEED_ROWS).toArrow()  # bounded by SEED_ROWS
    asked = base.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // block))
    path = f"{scratch(spark)}/top-{uuid.uuid4().hex}"
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        held: dict[int, dict[str, np.ndarray]] = {}
        for width in np.unique(some.column("width").to_numpy()):
            mine, seed = (x.filter(pa.array(x.column("width").to_numpy() == width)) for x in (some, seeds))
            q, n = _matrix(mine.column("v"), int(width)), len(mine)
            low = _bounds(q, mine.column("row").to_numpy(), _matrix(seed.column("v"), int(width)), seed.column("row").to_numpy(), k)
            none = np.zeros((n, 1), np.int64)
            held[int(width)] = {"q": q, **{c: mine.column(c).to_numpy() for c in ("norm", "label", "row", "vec_id")}, "low": low[:, None], "high": np.full((n, 1), np.inf), "positive_id": none, "positive_score": none}
        _scan(base, held, k, True).write.mode("append").parquet(path)
    by = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row")
    met = spark.read.schema(FIELDS).parquet(path).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    best = stored(met.select(F.col("anchor_id").alias("query_id"), "rank", "vec_id", "score"), "met")
    discard(base)
    remove(spark, path)
    return best
