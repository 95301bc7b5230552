"""Alignment of two tokenizers on the same bytes.

Texts are cut before each space that follows a character other than white space. Neither tokenizer merges over such a cut
(checked on loading, else a text is one unit), so each different unit is encoded and aligned once. In a unit, the character
offsets of tokenizers and the spans of the sentencepiece proto are coarse cuts; between them, where tokens share a
character, the decoded bytes of the tokens tell where each one ends. Token ranges overlap once for each piece between
neighbouring ends of either side.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, portions, stored
from .tokens import _bytes_of, default_path

_CUT = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
UNITS = 1 << 19  # units that a worker keeps
PAIRS = 1 << 21  # counted id pairs that go to every task at once
FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def ends(lengths: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """The byte at which each token ends: its span's end where the next token starts behind it and the decoded bytes agree,
    else the last such place and the decoded lengths since then."""
    own, at = np.cumsum(lengths), np.arange(len(lengths))
    sure = np.append(coarse[1:] > coarse[:-1], True) & (coarse == own)
    last = np.maximum.accumulate(np.where(sure, at, -1))
    before = np.maximum(last, 0)
    return np.where(sure, coarse, np.where(last < 0, own, coarse[before] + own - own[before]))


class Aligner:
    """Both tokenizers, and what is known of the units met so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _bytes_of()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        with open(path_a, encoding="utf-8") as file:
            layout = json.load(file)
        cut = layout["pre_tokenizer"] or {}
        apart = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece goes on behind a space
        self.cuts = apart and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not layout["normalizer"]
        self.clear()

    def clear(self) -> None:
        """Forgets all units. Numbers count the units that have tokens; ``counts``: of A, B, groups and links."""
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts, self.links, self.first = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the bytes at which the tokens' spans end."""
        found = self.a.encode(text, add_special_tokens=False)
        spans = found.offsets
        end = np.fromiter((e for _, e in spans), np.int64, len(spans))
        letters = np.frombuffer(text.encode(), np.uint8)
        at = np.append(np.flatnonzero((letters & 0xC0) != 0x80), len(letters))  # the byte at which each character starts
        return np.array(found.ids, np.int64), at[end]

    def _b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same; the model puts the first space before the text itself, and gives nothing for an empty text."""
        if text == " ":
            return np.array([self.space]), np.array([1])
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        return np.array([p.id for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64) + 1

    def learn(self, units: list[str]) -> None:
        """Encodes and aligns units, each of which starts with a space. Those that end with white space go alone, the others
        together, as they follow each other in texts. Units whose bytes differ get no number."""
        joined = [u for u in units if not u[-1:].isspace()]
        parts = [joined[k : k + 4096] for k in range(0, len(joined), 4096)] + [[u] for u in units if u[-1:].isspace()]
        while parts:
            part = parts.pop()
            if not self._learn(part):
                if len(part) == 1:
                    self.place[part[0]] = -1
                else:
                    parts += [part[: len(part) // 2], part[len(part) // 2 :]]

    def _learn(self, units: list[str]) -> bool:
        text = "".join(units)
        whole = text.encode()
        stops = np.cumsum([len(u.encode()) for u in units])
        sides = []
        for encode, table, size in ((self._a, self.bytes_a, self.size_a), (self._b, self.bytes_b, self.size_b)):
            ids, coarse = encode(text)
            if b"".join(map(table.__getitem__, ids.tolist())) != whole:
                return False
            at = ends(size[ids], coarse)
            tails = np.searchsorted(at, stops)
            if (at[tails] != stops).any():
                return False
            sides.append((ids, at, np.diff(tails, prepend=-1)))
        (a, ends_a, count_a), (b, ends_b, count_b) = sides
        shared, every = np.intersect1d(ends_a, ends_b, assume_unique=True), np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, every)] << 32 | b[np.searchsorted(ends_b, every)]
        groups, linked = (np.diff(np.searchsorted(x, np.append(0, stops), "right")) for x in (shared, every))
        # the groups as text: the tokens of A, then those of B, a sign behind each
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        spot_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        spot_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        tokens, signs = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        tokens[spot_a], tokens[spot_b] = a, b
        signs[spot_a[np.append(group_a[1:] > group_a[:-1], True)]] = 1
        signs[spot_b[np.append(group_b[1:] > group_b[:-1], True)]] = 2
        tails = np.cumsum(count_a + count_b)
        signs[tails - 1] = 3  # behind the last one of a unit
        written = "".join([f"{t}{',|;!'[k]}" for t, k in zip(tokens.tolist(), signs.tolist(), strict=True)])
        self.place.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups += written.split("!")[:-1]
        self.first = np.append(self.first, len(self.links) + np.cumsum(linked) - linked)
        self.counts = np.concatenate([self.counts, np.stack([count_a, count_b, groups, linked], 1)])
        self.links = np.concatenate([self.links, links])
        return True

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts (A, B, groups, links) and groups of each text (zeros and an empty string without tokens); of all texts,
        in their order, distinct links, how often each occurs, and its row."""
        if len(self.place) > UNITS:
            self.clear()
        cut = [(_CUT.split(f" {t}") if self.cuts else [f" {t}"]) if t else [] for t in texts]
        self.learn(list({u: 1 for units in cut for u in units if u not in self.place}))
        groups, numbers = [], []
        for names in cut:
            units = [self.place[u] for u in names]
            units = [] if -1 in units else units
            groups.append(";".join([self.groups[u] for u in units]))
            numbers.append(units)
        row = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        code, times = np.unique(row * (len(self.groups) + 1) + np.array([u for n in numbers for u in n], np.int64), return_counts=True)
        row, unit = np.divmod(code, len(self.groups) + 1)
        counts = np.zeros((len(texts), 4), np.int64)
        np.add.at(counts, row, self.counts[unit] * times[:, None])
        n = self.counts[unit, 3]
        links = self.links[np.repeat(self.first[unit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        width, space = len(self.bytes_b), len(self.bytes_a) * len(self.bytes_b)
        code, back = np.unique(np.repeat(row, n) * space + (links >> 32) * width + (links & 0xFFFFFFFF), return_inverse=True)
        often = np.bincount(back, np.repeat(times, n), len(code)).astype(np.int64)
        row, code = np.divmod(code, space)
        return counts, groups, code // width << 32 | code % width, often, row


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str, groups: bool = False) -> DataFrame:
    """doc_id, counts, the digest of the groups (and the groups, if asked for), distinct links (a << 32 | b) as ``keys``
    with their numbers as ``times``: a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in portions(batches, "text", 4 << 20):
            counts, written, keys, times, row = both.texts(batch.column(1).to_pylist())
            digests = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written])
            at = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))), pa.int32())
            columns = [batch.column(0), *map(pa.array, counts.T), digests, pa.ListArray.from_arrays(at, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]
            if groups:
                columns, names = [*columns, pa.array(written)], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FIELDS}, keys array<long>, times array<int>" + (", groups string" if groups else ""))


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def link_counts(found: DataFrame) -> DataFrame:
    """key, n, best: in how many rows an id pair is linked, and whether no pair of its A id has more. Keys are counted in
    each batch first; an A id has at most as many pairs as B has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    counts = found.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("key", 32)))
    return counts.withColumn("best", F.col("n") == most)


def _added(found: DataFrame, rows: pa.Table, first: bool, last: bool) -> DataFrame:
    """Adds what one part of the counted pairs gives to n_best and count_sum."""
    order = np.argsort(rows.column("key").to_numpy(), kind="stable")
    counts = rows.column("n").to_numpy()[order], rows.column("best").to_numpy(zero_copy_only=False)[order]
    sent = found.sparkSession.sparkContext.broadcast((rows.column("key").to_numpy()[order], *counts))  # about PAIRS rows
    kept = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns, strict=True))
            keys, row = _list(of["keys"])
            times = of["times"].flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            at, row, times = at[hit], row[hit], times[hit]
            sums = [np.zeros(batch.num_rows, np.int64) if first else of[c].to_numpy() for c in ("n_best", "count_sum")]
            for k, value in enumerate((times * best[at], times * n[at])):
                part = np.zeros(batch.num_rows, np.int64)
                np.add.at(part, row, value)
                sums[k] = sums[k] + part
            rest = [] if last else ["keys", "times"]
            yield pa.RecordBatch.from_arrays([*(of[c] for c in [*kept, *rest]), *map(pa.array, sums)], [*kept, *rest, "n_best", "count_sum"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, {FIELDS}{'' if last else ', keys array<long>, times array<int>'}, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each row.

    Each text is encoded by A behind a space and by B, which adds it itself; strings of special tokens are plain text. The
    bytes at which tokens of both sides end cut them into groups; two tokens are linked where their bytes overlap. A link
    counts the rows of the table that hold its id pair; ``n_best`` are links whose count is the highest of their A id.

    Texts that are null or empty or that the tokens' bytes do not give back have no tokens: zeros and an empty digest.
    Every row gives a row, and rows of null or repeated ids and equal texts count each. Texts are never cut. An empty
    table gives no rows; other columns are ignored. More than ``pairs`` different pairs are added up in several passes.
    """
    if path_b is None:
        import public_tokenizers

        path_b = public_tokenizers.path("piece_bpe_32k.model")
    found = stored(aligned(docs, path_a or default_path(), path_b), "aligned")
    counts = stored(link_counts(found), "links")
    passes = max(1, -(-counts.count() // pairs))
    out, kept = found, None
    for k in range(passes):
        rows = counts.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).toArrow()
        last = k == passes - 1
        out = _added(out, rows, k == 0, last)
        if not last:
            before, kept = kept or found, stored(out, "aligned")
            discard(before)
            out = kept
    discard(counts)
    return out
