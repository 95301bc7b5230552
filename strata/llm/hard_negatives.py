"""Hard negatives by coordinate pruning on length buckets.

Vectors are sorted by label and length; runs of a label and like length are buckets. For an anchor, the worst score that
can still matter gives a bucket a local cosine threshold: over 1 the bucket is skipped; where it is high, the anchor's
largest coordinates (its focus) have feasible ranges, which are cut out of the bucket's sorted coordinate lists and
intersected; else the bucket is cut by length alone. What is left is verified by exact products. Anchors go round in
blocks of bounded size; each task keeps the best of its own candidates only, and the partial lists are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, remove, scratch, stored

ANCHORS = 8192  # anchors that go to every task at once
BUCKET, LEAST, ALIKE = 2048, 256, 0.8  # rows of a bucket at most, at least, and its shortest by its longest vector
SLICE = 256  # anchors whose products are held at once
FOCUS = 3
NEAR = 0.5  # local cosine from which coordinates are selective
FIELDS = "anchor_row long, anchor_id long, slot int, positive_id long, positive_score long, row long, vec_id long, score long"


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (floor of ``scale`` times each component), width, norm; rows without id or label, and those whose
    vector is null or holds null or non-finite components, go."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    kept = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(sound)
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).withColumns({"width": F.size("v"), "norm": norm})


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), width) if width else np.zeros((len(column), 0))


class Bucket:
    """Vectors of one label and like length, the longest first."""

    def __init__(self, p: np.ndarray, norms: np.ndarray, ids: np.ndarray, rows: np.ndarray, label: int) -> None:
        self.p, self.norms, self.ids, self.rows, self.label = p, norms, ids, rows, label
        self._lists: tuple[np.ndarray, np.ndarray] | None = None

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """The values of each coordinate of the vectors at unit length, sorted, and whose they are."""
        if self._lists is None:
            unit = self.p / np.maximum(self.norms, 1e-300)[:, None]
            order = np.argsort(unit, axis=0)
            self._lists = np.take_along_axis(unit, order, 0), order
        return self._lists

    def feasible(self, q: np.ndarray, norm: float, local: float) -> np.ndarray:
        """Rows whose focus coordinates allow a cosine of ``local`` to q."""
        values, order = self.lists()
        marks, reach = np.zeros(len(self.p), np.int8), np.arccos(min(1.0, local))
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        for f in focus:
            angle = np.arccos(np.clip(q[f] / norm, -1, 1))
            low, high = np.cos(min(np.pi, angle + reach)) - 1e-9, np.cos(max(0.0, angle - reach)) + 1e-9
            marks[order[np.searchsorted(values[:, f], low, "left") : np.searchsorted(values[:, f], high, "right"), f]] += 1
        return np.flatnonzero(marks == len(focus))


class Anchors:
    """A block of anchors of one width with score windows (low, high) and the best ``k`` rows found so far in each."""

    def __init__(self, q: np.ndarray, norms: np.ndarray, labels: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.q, self.norms, self.labels, self.rows, self.high, self.k, self.same = q, norms, labels, rows, high, k, same
        self.bound = np.where(low <= high, low, np.inf)  # an empty window asks for nothing
        shape = (*low.shape, k)
        self.scores, self.ids, self.hits = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1)

    def meet(self, b: Bucket) -> None:
        least, most = self.bound.min(axis=1), self.high.max(axis=1)
        wanted = (self.labels == b.label) == self.same
        longest = self.norms * b.norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(least <= 0, 0.0, np.where(longest > 0, least / longest, np.inf))
        wanted &= local <= 1 + 1e-9
        for i in np.flatnonzero(wanted & (local > NEAR)):
            at = b.feasible(self.q[i], self.norms[i], local[i])
            self._keep(np.full(len(at), i), at, b.p[at] @ self.q[i], b)
        rest = np.flatnonzero(wanted & (local <= NEAR))
        rest = rest[np.argsort(local[rest], kind="stable")]
        for low in range(0, len(rest), SLICE):
            some = rest[low : low + SLICE]
            shortest = np.where(least[some] > 0, least[some] * (1 - 1e-9) / np.maximum(self.norms[some], 1e-300), 0.0).min()
            count = int(np.searchsorted(-b.norms, -shortest, side="right"))  # the rows that are long enough for one of them
            scores = self.q[some] @ b.p[:count].T
            i, at = np.nonzero((scores >= least[some][:, None]) & (scores <= most[some][:, None]))
            self._keep(some[i], at, scores[i, at], b)

    def _keep(self, who: np.ndarray, at: np.ndarray, scores: np.ndarray, b: Bucket) -> None:
        """Merges verified products into the lists and raises the bounds."""
        for slot in range(self.bound.shape[1]):
            ok = (scores >= self.bound[who, slot]) & (scores <= self.high[who, slot]) & (b.rows[at] != self.rows[who])
            if not ok.any():
                continue
            new = np.unique(who[ok])
            a = np.concatenate([who[ok], np.repeat(new, self.k)])
            s = np.concatenate([scores[ok], self.scores[new, slot].ravel()])
            ids = np.concatenate([b.ids[at[ok]], self.ids[new, slot].ravel()])
            rows = np.concatenate([b.rows[at[ok]], self.hits[new, slot].ravel()])
            order = np.lexsort((rows, ids, -s, a))
            a = a[order]
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            best = order[starts[:, None] + np.arange(self.k)]  # each anchor has its k old places at least
            self.scores[new, slot], self.ids[new, slot], self.hits[new, slot] = s[best], ids[best], rows[best]
            self.bound[new, slot] = np.maximum(self.bound[new, slot], self.scores[new, slot, -1])


def _buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, Bucket]]:
    """(width, bucket) of the runs of a sorted batch."""
    widths, labels, norms, ids, rows = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("width", "label", "norm", "vec_id", "row"))
    vectors = batch.column(batch.schema.get_field_index("v"))
    fresh = np.append(True, (widths[1:] != widths[:-1]) | (labels[1:] != labels[:-1]) | (norms[1:] > norms[:-1])) if len(ids) else np.zeros(0, bool)
    for low, high in zip(np.flatnonzero(fresh), np.append(np.flatnonzero(fresh)[1:], len(ids))):
        while low < high:
            alike = low + int(np.searchsorted(-norms[low:high], -norms[low] * ALIKE, side="right"))
            end = min(high, low + BUCKET, max(alike, low + LEAST))
            width = int(widths[low])
            yield width, Bucket(_matrix(vectors.slice(low, end - low), width), norms[low:end], ids[low:end], rows[low:end], int(labels[low]))
            low = end


def _scan(base: DataFrame, blocks: dict, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows of each task for each window of the anchors: one pass over the vectors, without a shuffle."""
    sent = base.sparkSession.sparkContext.broadcast(blocks)  # ANCHORS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {w: Anchors(x["q"], x["norm"], x["label"], x["row"], x["low"], x["high"], k, same) for w, x in sent.value.items()}
        for batch in batches:
            for width, bucket in _buckets(batch):
                if width in held:
                    held[width].meet(bucket)
        for width, found in held.items():
            x = sent.value[width]
            i, slot, place = np.nonzero(found.scores > -np.inf)
            columns = [x["row"][i], x["vec_id"][i], slot, x["positive_id"][i, slot], x["positive_score"][i, slot], found.hits[i, slot, place], found.ids[i, slot, place], found.scores[i, slot, place]]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if n == "slot" else np.int64)) for n, c in zip(names, columns, strict=True)], names)

    return base.mapInArrow(run, FIELDS)


def _best(met: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; scores are inner products of the floors of ``scale`` times
    the components. An anchor's positives are its best other rows of its label; for each, the best rows of other labels
    whose score lies between ``least`` and ``most`` hundredths of the positive's are returned, ties by smaller vec_id.

    Rows without vec_id or label, null vectors and those with null or non-finite components take no part; vectors meet
    those of their own width only. Rows that share a vec_id are rows of their own: each is an anchor, a positive and a
    negative for itself. Anchors without positives, and positives of negative score, give nothing. An empty table gives
    no rows; other columns are ignored. Scores are exact below 2 ** 53.
    """
    spark = vectors.sparkSession
    order = ["width", "label", F.desc("norm"), "vec_id"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = prepared(vectors, scale).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    base = stored(dealt.withColumn("row", F.monotonically_increasing_id()), "vectors")  # kept as written, so rows stay what they are
    asked = base.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // anchors))
    path = f"{scratch(spark)}/negatives-{uuid.uuid4().hex}"
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()  # about ANCHORS rows
        held: dict[int, dict[str, np.ndarray]] = {}
        widths = block.column("width").to_numpy()
        for width in np.unique(widths):
            some = block.filter(pa.array(widths == width))
            n = len(some)
            held[int(width)] = {"q": _matrix(some.column("v"), int(width)), **{c: some.column(c).to_numpy() for c in ("norm", "label", "row", "vec_id")}, "low": np.full((n, 1), -np.inf), "high": np.full((n, 1), np.inf), "positive_id": np.zeros((n, 1), np.int64), "positive_score": np.zeros((n, 1), np.int64)}
        found = _best(_scan(base, held, positives, True), positives).select("anchor_row", "rank", "vec_id", "score").toArrow()  # ``positives`` rows an anchor
        for x in held.values():
            n = len(x["row"])
            x["positive_id"], x["positive_score"] = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
            x["low"], x["high"] = np.full((n, positives), np.inf), np.full((n, positives), -np.inf)
            by = np.argsort(x["row"])
            rows = found.column("anchor_row").to_numpy()
            at = np.minimum(np.searchsorted(x["row"], rows, sorter=by), n - 1)
            mine_ = x["row"][by[at]] == rows
            i, slot = by[at[mine_]], found.column("rank").to_numpy()[mine_] - 1
            score = found.column("score").to_numpy()[mine_]
            x["positive_id"][i, slot], x["positive_score"][i, slot] = found.column("vec_id").to_numpy()[mine_], score
            x["low"][i, slot], x["high"][i, slot] = -(-least * score // 100), most * score // 100
        _scan(base, held, negatives, False).write.mode("append").parquet(path)
    best = stored(_best(spark.read.schema(FIELDS).parquet(path), negatives), "mined")
    discard(base)
    remove(spark, path)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
