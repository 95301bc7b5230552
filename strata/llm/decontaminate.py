"""Benchmark decontamination by Wu-Manber search.

Texts and benchmark items become words behind one blank each, so an occurrence of ten consecutive item words is an
occurrence of one string. Windows of like length share a shift table: the eight bytes that end at a place tell how far the
next possible end is. Places that may end a window meet the windows of their suffix bucket, and a comparison of all bytes
decides. Many cursors walk a block of texts at once, each over its own stretch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import buffers, discard, portions, stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
MOST = 32 << 20  # bytes of windows that are searched in one pass
BITS = 20  # of the hash of a block
CURSORS = 4096
SPAN = "array<struct<start:long,end:long>>"

_LETTERS = np.full(256, 32, np.uint8)
for _low, _high in ((48, 57), (97, 122), (128, 255)):
    _LETTERS[_low : _high + 1] = np.arange(_low, _high + 1)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS.flags.writeable = False


def windows(benchmark: DataFrame) -> DataFrame:
    """Distinct (window, item): each ``WINDOW`` consecutive words of an item, or all words of a shorter one, every word between
    blanks. Items without id or words have none; rows of one id are one item."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0))
    found = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).filter("item is not null and size(w) > 0")
    size = F.least(F.size("w"), F.lit(WINDOW))
    text = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i, size), " "), F.lit(" ")))
    return found.select(F.explode(text).alias("window"), "item").distinct()


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of bytes, each a line feed, a blank and its words with a blank behind each; second, where each
    text begins. Null is a text without words."""
    raw, at = buffers(texts)
    count = len(at) - 1
    out = np.full(len(raw) + 3 * count, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(3 * np.arange(count) + 2, np.diff(at))] = _LETTERS[raw]
    out[at[:-1] + 3 * np.arange(count)] = 10
    blank = out == 32
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    out = out[kept]
    return out, np.flatnonzero(out == 10)


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, without copying; the data end with eight spare bytes."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


class Windows:
    """Strings of like length with their shift table and suffix buckets."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        self.least = int(self.lengths.min())
        self.width = min(8, self.least)
        self.mask = np.uint64((1 << 8 * self.width) - 1)
        every, reach = _blocks(self.data), self.least - self.width
        self.shift = np.full(1 << BITS, min(reach + 1, 255), np.uint8)
        for j in range(reach + 1):
            np.minimum.at(self.shift, self._hash(every[self.starts + j]), min(reach - j, 255))
        ends = self._hash(every[self.starts + reach])
        self.order = np.argsort(ends, kind="stable")
        self.buckets, self.first = ends[self.order], every[self.starts] & self.mask

    def _hash(self, block: np.ndarray) -> np.ndarray:
        return (((block & self.mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which a window may start, and the hash of the block that ends its first ``least`` bytes."""
        every, last, back = _blocks(data), len(data) - 8 - self.least + 1, self.least - self.width
        stretch = max(1024, -(-last // CURSORS))
        at = np.arange(0, max(0, last), stretch)
        stop = np.minimum(at + stretch, last)
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            key = self._hash(every[at + back])
            step = self.shift[key]
            if len(hit := np.flatnonzero(step == 0)):
                places.append(at[hit])
                hashes.append(key[hit])
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return np.concatenate(places), np.concatenate(hashes)

    def found(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the window) of each occurrence."""
        at, key = self.candidates(data)
        low = np.searchsorted(self.buckets, key, "left")
        count = np.searchsorted(self.buckets, key, "right") - low
        at, rank = np.repeat(at, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        which = self.order[np.repeat(low, count) + rank]
        kept = (at + self.lengths[which] <= len(data) - 8) & ((_blocks(data)[at] & self.mask) == self.first[which])
        at, which = at[kept], which[kept]
        same = np.zeros(len(at), bool)
        chunk = max(1, (1 << 20) // int(self.lengths.max()))
        for low in range(0, len(at), chunk):  # all bytes, compared directly
            a, w = at[low : low + chunk], which[low : low + chunk]
            n = self.lengths[w]
            ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = data[np.repeat(a, n) + ramp] != self.data[np.repeat(self.starts[w], n) + ramp]
            same[low : low + chunk] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        return at[same], which[same]


class Searcher:
    """All windows of a pass. ``rows``: (window, item)."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.items = sorted({item for _, item in rows})
        number = {item: k for k, item in enumerate(self.items)}
        of: dict[str, list[int]] = {}
        for window, item in rows:
            of.setdefault(window, []).append(number[item])
        classes: dict[int, list[str]] = {}
        for window in of:
            classes.setdefault(min(len(window.encode()).bit_length(), 6), []).append(window)
        self.groups = []
        for same in classes.values():
            per = [of[w] for w in same]
            counts = np.array([len(p) for p in per], np.int64)
            self.groups.append((Windows([w.encode() for w in same]), np.array([w.count(" ") - 1 for w in same], np.int64), np.array([i for p in per for i in p], np.int64), np.cumsum(counts) - counts, counts))

    def search(self, texts: pa.Array, before: pa.Array | None) -> tuple[np.ndarray, pa.Array, list[tuple[int, str]]]:
        """Words of each text, its merged spans of hit words (with those found ``before``), and (row, item) pairs."""
        data, heads = normalised(texts)
        words = np.flatnonzero((data[1:] > 32) & (data[:-1] == 32)) + 1
        firsts = np.append(np.searchsorted(words, heads), len(words))
        data = np.append(data, np.zeros(8, np.uint8))
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if before is not None:
            spans, base = before.flatten(), np.repeat(firsts[:-1], before.value_lengths().to_numpy())
            starts.append(spans.field("start").to_numpy() + base)
            ends.append(spans.field("end").to_numpy() + base)
        pairs: list[np.ndarray] = [np.zeros(0, np.int64)]
        for group, sizes, items, low, counts in self.groups:
            at, which = group.found(data)
            word = np.searchsorted(words, at + 1)
            starts.append(word)
            ends.append(word + sizes[which])
            seen = np.unique((np.searchsorted(heads, at, "right") - 1) * len(sizes) + which)  # each window once a text
            row, which = np.divmod(seen, len(sizes))
            n = counts[which]
            ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.unique(np.repeat(row, n) * len(self.items) + items[np.repeat(low[which], n) + ramp]))
        size = len(words) + 1
        hit = np.cumsum(np.bincount(np.concatenate(starts), minlength=size) - np.bincount(np.concatenate(ends), minlength=size))[:-1] > 0
        border = np.zeros(size, bool)
        border[firsts] = True
        opens = np.flatnonzero(hit & (border[:-1] | ~np.append(False, hit[:-1])[: len(hit)]))
        closes = np.flatnonzero(hit & (border[1:] | ~np.append(hit[1:], False)[: len(hit)])) + 1
        row = np.searchsorted(firsts, opens, "right") - 1
        counts = np.bincount(row, minlength=len(heads))
        values = pa.StructArray.from_arrays([pa.array(opens - firsts[row], pa.int64()), pa.array(closes - firsts[row], pa.int64())], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
        return np.diff(firsts), spans, [(int(c) // len(self.items), self.items[int(c) % len(self.items)]) for c in np.unique(np.concatenate(pairs))]


_built: dict[str, Searcher] = {}


def _pass(docs: DataFrame, rows: list[tuple[str, str]], name: str, first: bool, last: bool) -> DataFrame:
    """Adds what one part of the windows finds to doc_id, text, spans, items."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)  # at most about MOST bytes of windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Searcher(sent.value)
        for batch in portions(batches, "text"):
            words, spans, pairs = _built[name].search(batch.column(1), None if first else batch.column(2))
            items: dict[int, set[str]] = {}
            if not first:
                items = {k: set(x) for k, x in enumerate(batch.column(3).to_pylist()) if x}
            for k, item in pairs:
                items.setdefault(k, set()).add(item)
            listed = pa.array([sorted(items.get(k, ())) for k in range(batch.num_rows)], pa.list_(pa.string()))
            rest = [pa.array(words, pa.int64())] if last else [batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, spans, listed], ["doc_id", "n_words" if last else "text", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {'n_words long' if last else 'text string'}, spans {SPAN}, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_words, spans, items: the words of each text, the ranges of words (end exclusive, merged) that lie in an
    occurrence of a window of the benchmark, and the items with occurring windows, sorted as strings.

    Words are runs of 0-9, a-z (A-Z are lower-cased) and all characters above U+007F. Null and empty texts have no words.
    Every row of ``docs`` gives a row, null and repeated ids and equal texts included. Items without id or words search for
    nothing; an empty benchmark hits nothing, an empty table gives no rows. Other columns are ignored. A text is never
    cut. Windows of more than ``most`` bytes are dealt to several passes by their hash.
    """
    found = stored(windows(benchmark), "windows")
    total = found.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    passes, kept, run = max(1, -(-total // most)), None, uuid.uuid4().hex
    out = docs.select("doc_id", "text")
    for k in range(passes):
        rows = [tuple(r) for r in found.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == k).select("window", "item").collect()]
        last = k == passes - 1
        out = _pass(out, rows, f"{run}-{k}", k == 0, last)
        if not last:
            before, kept = kept, stored(out, "searched")
            discard(before)
            out = kept
    discard(found)
    return out
