"""N-gram Jaccard join by multiple-global-order filtering, and the components of its links.

Tokens are hashed 5-word shingles; copies are one class, a node of the graph. Sets that reach the threshold share tokens
of their prefixes under every global order of the tokens. Two orders are used. Order A goes by hash: over all documents,
the first half of each set is dealt out by token, and classes of which too few of these tokens are found elsewhere to
reach the threshold with any other set end there. Among the rest, order B goes by exact counts, rare tokens first, so
that passages which many documents share come last and the places of shared tokens bound what two sets can still have in
common. Candidates share a token of their prefixes under B at places that fit, then one under A, and are verified on their
texts. Classes first meet one leader of a token a round, at first one that shares most with others; only what these links
do not bring together is compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import buffers, discard, portions, stored

WORDS = 5
PERCENT = 75
WINDOW = 1_000_000  # tokens that a task holds before it deals them out
RANGE = 4_000_000  # tokens of a hash range


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles (A-Z lower-cased, words between ASCII white space)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def _sets(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    raw, at = buffers(batch.column(column))
    data = raw.tobytes()
    return [shingles(data[at[k] : at[k + 1]]) for k in range(len(at) - 1)]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _prefix(n: int) -> int:
    """Tokens in the prefix of a set of n, of which a set that reaches the threshold has one in its own prefix."""
    return n - -(-n * PERCENT // 100) + 1


def _front(n: int) -> int:
    """Tokens in the first part of a set of n under order A."""
    return max(_prefix(n), (n + 1) // 2)


def _by_hash(tokens: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` tokens under order A."""
    return tokens[np.argsort(tokens.view(np.uint64) * np.uint64(0x9FB21C651E98DF25))[:count]]


def _part(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(ranges)


def marked(docs: DataFrame, ranges: int) -> DataFrame:
    """A row per document with n, id (digest of its set) and th (hash of its text); a row per window of a task with ids and
    ns, the classes that the task met there first; and rows per window and hash range with places and counts: how many
    tokens of the first half of a class's set under order A are also found elsewhere, for the classes at these places."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sent = {"doc_id": id_type, "n": "long", "id": "long", "th": "long", "win": "long", "ids": "array<bigint>", "ns": "array<int>", "toks": "binary", "steps": "binary", "part": "int"}
    got = {"doc_id": id_type, "n": "long", "id": "long", "th": "long", "win": "long", "ids": "array<bigint>", "ns": "array<int>", "places": "array<int>", "counts": "array<int>"}
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}

    def rows(fields: dict[str, str], kind: pa.DataType, m: int, **columns) -> pa.RecordBatch:
        """m rows; columns that are not given are null."""
        types = {c: kind if c == "doc_id" else arrow[t] for c, t in fields.items()}
        return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(m, t) for c, t in types.items()], list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        win, size, done = TaskContext.get().partitionId() << 24, 0, 0

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            """The window's row and one for each hash range: 32 bits of the tokens, and the steps between their places."""
            ids, ns = [h[0] for h in held], [h[1] for h in held]
            yield rows(sent, kind, 1, win=[win], ids=[ids], ns=[ns], part=[win % ranges])
            toks, doc = np.concatenate([h[2] for h in held]), np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            part = _part(toks, ranges)
            order = np.argsort(part, kind="stable")
            part, toks, doc = part[order], toks[order].view(np.uint64).astype("<u4"), doc[order]
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            cuts = list(zip([0, *ends[:-1]], ends, strict=True))
            yield rows(sent, kind, len(cuts), win=[win] * len(cuts), toks=[toks[i:j].tobytes() for i, j in cuts], steps=[np.diff(doc[i:j], prepend=0).astype("<u2").tobytes() for i, j in cuts], part=[int(part[i]) for i, _ in cuts])
            held.clear()

        for batch in portions(batches, "text"):
            sets, kind = _sets(batch, 1), batch.schema.field(0).type
            ids = []
            for s in sets:
                digest = _digest(s)
                ids.append(_id(digest))
                if len(s) and digest not in seen:
                    seen.add(digest)
                    held.append((ids[-1], len(s), _by_hash(s, _front(len(s)))))
                    size += len(held[-1][2])
                    if size > WINDOW or len(held) > 60_000:  # a step has 16 bits
                        yield from flush(kind)
                        win, size = win + 1, 0
            m = len(sets)
            yield rows(sent, kind, m, doc_id=batch.column(0), n=[len(s) for s in sets], id=ids, th=batch.column(2), part=np.arange(done, done + m) % ranges)
            done += m
        if held:
            yield from flush(kind)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes documents and windows on; all tokens of a range are here."""
        wins, toks, steps = [], [], []
        for batch in batches:
            own = batch.filter(batch.column(7).is_valid())
            rest = batch.filter(batch.column(7).is_null())
            for w, t, d in zip(own.column(4).to_pylist(), own.column(7).to_pylist(), own.column(8).to_pylist(), strict=True):
                wins.append(w)
                toks.append(np.frombuffer(t, "<u4"))
                steps.append(np.frombuffer(d, "<u2"))
            kind = batch.schema.field(0).type
            yield rows(got, kind, rest.num_rows, **{c: rest.column(k) for k, c in enumerate(list(sent)[:7])})
        if not toks:
            return
        _, where, counts = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
        often, at = counts[where] > 1, 0
        for w, d in zip(wins, steps, strict=True):
            found = np.bincount(np.cumsum(d, dtype=np.int64), weights=often[at : at + len(d)]).astype(np.int32)
            at += len(d)
            places = np.flatnonzero(found)
            yield rows(got, kind, 1, win=[w], places=[places.astype(np.int32)], counts=[found[places]])

    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    schema = lambda fields: ", ".join(f"{c} {t}" for c, t in fields.items())
    return given.mapInArrow(run, schema(sent)).repartitionById(ranges, F.col("part")).mapInArrow(shared, schema(got))


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the classes of which enough tokens are found elsewhere; rows are sorted by window.

    Of the first L tokens of a set of n at most n - needed are not in a set that reaches the threshold with it, so at least
    L - (n - needed) are found there, in its own first half; one less is asked for, as lengths are rounded.
    """
    now, ids, ns, found = None, None, None, []

    def chosen() -> pa.RecordBatch:
        total = np.zeros(len(ids), np.int64)
        for places, counts in found:
            total[places] += counts
        rest = ns - -(-ns * PERCENT // 100)
        enough = np.maximum(1, np.maximum(rest + 1, (ns + 1) // 2) - rest - 1)
        return pa.RecordBatch.from_arrays([pa.array(ids[total >= enough])], ["id"])

    for batch in batches:
        for k, w in enumerate(batch.column(0).to_pylist()):
            if w != now:
                if now is not None:
                    yield chosen()
                now, found = w, []
            if batch.column(1)[k].is_valid:
                ids, ns = batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy().astype(np.int64)
            else:
                found.append((batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy()))
    if now is not None:
        yield chosen()


def _dealt(held: list[tuple[int, int, np.ndarray]], ranges: int) -> list[tuple]:
    """part, toks, ids, ns, counts of the hash ranges of the held (id, n, tokens): ids[k] has the next counts[k] of toks."""
    toks = np.concatenate([h[2] for h in held])
    doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
    ids, ns = (np.array([h[k] for h in held], np.int64) for k in range(2))
    part = _part(toks, ranges)
    order = np.argsort(part, kind="stable")
    part, toks, doc = part[order], toks[order], doc[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    rows = []
    for i, j in zip(starts, [*starts[1:], len(part)], strict=True):
        who, counts = np.unique(doc[i:j], return_counts=True)
        rows.append((int(part[i]), toks[i:j], ids[who], ns[who], counts))
    held.clear()
    return rows


_RANGES = ["part", "toks", "ids", "ns", "counts"]


def _range_rows(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """token, id, n of a whole range, each (token, id) once, by token, then n, then id."""
    rows = []
    for batch in batches:
        if batch.num_rows:
            toks, ids, ns, counts = (batch.column(k).flatten().to_numpy() for k in range(1, 5))
            rows.append((toks, np.repeat(ids, counts), np.repeat(ns, counts)))
    if not rows:
        return None
    token, id_, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((id_, n, token))
    token, id_, n = token[order], id_[order], n[order]
    new = np.append(True, (token[1:] != token[:-1]) | (id_[1:] != id_[:-1]))
    return token[new], id_[new], n[new]


def _likely(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose text hash (th) may be among those of ``known``, by a table of bits: at most 16 MB, however many there are."""
    bits = min(27, known.count().bit_length() + 5)
    slot = F.shiftrightunsigned("th", 64 - bits)
    filled = known.select(slot.alias("slot")).groupBy(F.expr("slot div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask")).toPandas()
    words = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    words[filled["word"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("th")).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield batch.filter(pa.array((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0))

    return docs.mapInArrow(run, docs.schema)


def second_order(texts: DataFrame, ranges: int) -> DataFrame:
    """Class rows (id, n, a: the prefix under order A, 32 bits a token) and range rows (part, toks, ids, ns, counts: ids[k]
    has the next counts[k] of toks) of the whole sets, for counting."""
    names, whole = ["id", "n", "a", *_RANGES], pa.list_(pa.int32())
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), whole, whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*_dealt(held, ranges), strict=True), kinds, strict=True)]
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, whole), *columns], names)

        for batch in portions(batches, "text"):
            nodes = []
            for id_, s in zip(batch.column(0).to_pylist(), _sets(batch, 1), strict=True):
                if _id(_digest(s)) != id_:
                    continue  # another text under the same id and hash
                nodes.append((id_, len(s), _by_hash(s, _prefix(len(s))).view(np.uint64).astype(np.uint32).view(np.int32)))
                held.append((id_, len(s), s))
                size += len(s)
            if nodes:
                columns = [pa.array(c, t) for c, t in zip(zip(*nodes, strict=True), (pa.int64(), pa.int32(), whole), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(nodes), t) for t in kinds)], names)
            if size > WINDOW:
                yield flush()
                size = 0
        if held:
            yield flush()

    return texts.select("id", "text").mapInArrow(run, "id long, n int, a array<int>, part int, toks array<bigint>, ids array<bigint>, ns array<int>, counts array<int>")


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, ids, ns, sizes, toks, freqs: the tokens of the range that several sets have, and how many, dealt out by id:
    ids[k] of the bucket has the next sizes[k] of toks."""
    if (rows := _range_rows(batches)) is None:
        return
    token, id_, n = rows
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    counts = np.diff(np.append(starts, len(token)))
    freq = np.repeat(counts, counts)
    keep = np.flatnonzero(freq > 1)
    if not len(keep):
        return
    bucket = id_[keep].view(np.uint64) % np.uint64(buckets)
    order = np.lexsort((id_[keep], bucket))
    keep, bucket = keep[order], bucket[order]
    token, id_, n, freq = token[keep], id_[keep], n[keep], freq[keep]
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    out = []
    for i, j in zip([0, *ends[:-1]], ends, strict=True):
        first = np.flatnonzero(np.append(True, id_[i + 1 : j] != id_[i : j - 1]))
        out.append((int(bucket[i]), id_[i:j][first], n[i:j][first], np.diff(np.append(first, j - i)), token[i:j], freq[i:j]))
    kinds = [pa.int32(), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "ids", "ns", "sizes", "toks", "freqs"])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, id, n, mid, pos: prefixes under order B; all rows of a bucket are here. Tokens that no other set has stand
    before all others. mid: mean log2 of the counts, high amid a group of near copies."""
    rows = []
    for batch in batches:
        if batch.num_rows:
            ids, ns, sizes, toks, freqs = (batch.column(k).flatten().to_numpy() for k in range(1, 6))
            rows.append((toks, np.repeat(ids, sizes), np.repeat(ns, sizes), freqs))
    if not rows:
        return
    token, id_, n, freq = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((token * np.int64(-6884282663029611473), freq, id_))
    token, id_, n, freq = token[order], id_[order], n[order].astype(np.int64), freq[order]
    starts = np.flatnonzero(np.append(True, id_[1:] != id_[:-1]))
    counts = np.diff(np.append(starts, len(id_)))
    mid = np.repeat(1000 * np.add.reduceat(np.log2(freq), starts) / n[starts], counts).astype(np.int32)
    pos = np.arange(len(id_)) - np.repeat(starts, counts) + n - np.repeat(counts, counts)  # behind those that it alone has
    keep = np.flatnonzero(pos < n + (-n * PERCENT // 100) + 1)
    for k in range(0, len(keep), 50_000):
        at = keep[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(x[at].astype(t)) for x, t in ((token, np.int64), (id_, np.int64), (n, np.int32), (mid, np.int32), (pos, np.int32))], ["token", "id", "n", "mid", "pos"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, comp: the smallest id reachable over links (a, b); by label spreading with pointer jumping."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, last = nodes.select("id", F.col("id").alias("comp")), None
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("low"))
        heads = labels.select(F.col("id").alias("head"), F.col("comp").alias("jump"))
        new = stored(spread.join(heads, spread["low"] == heads["head"]).select("id", "old", F.least("low", "jump").alias("comp")), "labels")
        discard(last)
        labels, last = new.select("id", "comp"), new
        if not new.filter("comp <> old").take(1):
            out = stored(labels, "components")
            discard(last, edges)
            return out


def _needed(x: str, y: str) -> Column:
    """Tokens that sets of these sizes must share."""
    return F.ceil(PERCENT * (F.col(x) + F.col(y)) / (100 + PERCENT)).cast("int")


def _fits(x: str, y: str) -> Column:
    """Whether two sets can reach the threshold if this is the first token, in order B, that they share."""
    rest = lambda s: F.col(f"{s}.n") - F.col(f"{s}.pos")
    return F.least(rest(x), rest(y)) >= _needed(f"{x}.n", f"{y}.n")


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs that reach the threshold; rows are sorted by a, salt and role, a leader (role 0) before the rest."""
    key, lead = None, None
    for batch in portions(batches, "text"):
        found = []
        for a, salt, role, id_, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), _sets(batch, 4), strict=True):
            if not role:
                key, lead = (a, salt), tokens
            elif key == (a, salt):
                both = len(np.intersect1d(lead, tokens, assume_unique=True))
                if 100 * both >= PERCENT * (len(lead) + len(tokens) - both):
                    found.append((a, id_))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _row_key(doc_id: str, text_hash: str) -> list[Column]:
    """Columns that tell rows apart by id, null among them, and text hash."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id_key"), F.col(doc_id).isNull().alias("_no_id"), F.col(text_hash).alias("_text_key")]


KEYS = ["_id_key", "_no_id", "_text_key"]


def _linked(docs: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: rows (doc_id, n, id of the class; rows with ``win`` aside) and classes (id, least: a row of it as
    struct none, doc_id, th, comp)."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(parts, size // (12 * RANGE) + 1)  # a shingle for each word of six bytes, and half of them are dealt out
    both = stored(marked(docs, ranges), "marks")
    marks = both.filter("win is null").select("doc_id", "n", "th", "id")
    classes = stored(marks.filter("n > 0").groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")), "classes")
    windows = both.filter("win is not null").select("win", "ids", "ns", "places", "counts")
    active = stored(windows.repartition(parts, "win").sortWithinPartitions("win").mapInArrow(_active, "id long").distinct(), "active")
    known = stored(classes.join(active, "id").select("id", F.col("least.th").alias("th"), *_row_key("least.doc_id", "least.th")), "known")
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th"))
    texts = stored(_likely(given, known).select("text", *_row_key("doc_id", "th")).join(known.drop("th"), KEYS).select("id", "text").dropDuplicates(["id"]), "texts")
    discard(active, known)
    made = stored(second_order(texts, ranges), "sets")
    first = made.filter("id is not null").select("id", "n", "a")
    dealt = made.filter("part is not null").select(*_RANGES).repartitionById(ranges, F.col("part"))
    counted = dealt.mapInArrow(lambda batches: _counted(batches, ranges), "bucket int, ids array<bigint>, ns array<int>, sizes array<int>, toks array<bigint>, freqs array<int>")
    posts = stored(counted.repartitionById(ranges, F.col("bucket")).mapInArrow(_ordered, "token long, id long, n int, mid int, pos int"), "posts")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (first.select(F.col("id").alias(i), F.col("n").alias(f"n{j}"), F.col("a").alias(j)) for i, j in ("ax", "by"))
        front = lambda j: F.slice(j, F.lit(1), F.col(f"n{j}") - _needed("nx", "ny") + 1)  # noqa: E731  where the first shared token must lie
        open_ = stored(pairs.distinct().join(x, "a").join(y, "b").filter(F.arrays_overlap(front("x"), front("y"))).select("a", "b"), "pairs")
        salts = open_.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("salts"))
        lead = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
        rest = open_.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
        dealt = lead.union(rest).join(texts, "id").select("a", "salt", "role", "id", "text")
        found = stored(dealt.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_reach, "a long, b long").distinct(), "links")
        discard(open_)
        return found

    links, comps = [], None
    for k in range(rounds + 1):
        held = posts.withColumn("comp", F.col("id")) if comps is None else posts.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = held.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by(F.struct("id", "n", "comp", "pos"), F.struct(-F.col("mid") if k == 0 else F.xxhash64("id", F.lit(k)), "id")).alias("lead")).filter("c0 <> c1").select("token", "lead")
        open_ = held.join(mixed, "token")
        if k:  # tokens within one component are done
            open_ = stored(open_, "open")
            discard(posts)
            posts = open_
        if k < rounds:
            met = open_.withColumn("own", F.struct("n", "pos")).filter((F.col("comp") != F.col("lead.comp")) & _fits("own", "lead")).groupBy("id", F.col("lead.id").alias("a")).agg(F.count("*").alias("votes"))
            pairs = met.groupBy(F.col("id").alias("b")).agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")
        else:
            x, y = open_.alias("x"), open_.alias("y")
            apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))
            pairs = x.join(y, apart & _fits("x", "y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        found = verified(pairs)
        posts = posts.drop("comp", "lead") if k == 0 else stored(open_.drop("comp", "lead"), "posts")
        if k:
            discard(open_)
        if found.take(1):
            links.append(found)
            every = links[0]
            for more in links[1:]:
                every = every.union(more)
            discard(comps)
            comps = components(every.select(F.col("a").alias("id")).union(every.select("b")).distinct(), every)
        else:
            discard(found)
    named = stored(classes.withColumn("comp", F.col("id")) if comps is None else classes.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "named")
    discard(classes, comps, posts, made, texts, *links)
    return both, named


def link_components(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of 100 * shared >= 75 * union).

    Null and empty texts have no shingles, link with nothing and are their own component. Repeated rows keep their
    own rows, and rows of one doc_id with different texts are nodes of their own; rows without id are nodes like others,
    but give no component_id where there is another. An empty table gives none. ``rounds`` of leaders only save work: the
    full comparison behind them covers all that is still apart. Sets are told apart by the first 64 bits of their digest.
    """
    marks, member = _linked(docs, rounds)
    smallest = member.groupBy("comp").agg(F.min("least")["doc_id"].alias("component_id"))
    named = stored(member.join(smallest, "comp").select("id", "component_id"), "components")
    discard(member)
    out = marks.filter("win is null").select("doc_id", "n", "id").join(named, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """One row of each component, of its smallest id (null last) and text hash; rows without words are kept each."""
    words = F.coalesce(F.col("text").rlike(r"[^ \t\n\r\x0B\f]"), F.lit(False))
    marks, member = _linked(docs, rounds)
    heads = stored(member.groupBy("comp").agg(F.min("least").alias("least")).select(*_row_key("least.doc_id", "least.th")), "heads")
    discard(marks, member)
    rows = docs.filter(words).withColumn("_th", F.xxhash64("text")).select(*docs.columns, *_row_key("doc_id", "_th"))
    once = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.lit(0)))).filter("_copy = 1")
    return once.join(heads, KEYS, "left_semi").select(*docs.columns).union(docs.filter(~words))
