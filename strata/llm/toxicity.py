"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over all texts. Suspicious stretches (letters mixed with leetspeak, letters set
apart by spaces or signs, repeated letters) become lattices of the letters that each sign may stand for; Viterbi decoding
under the model restores them. Words and restored words give prefix features; their log odds come from labelled texts,
and a logistic curve over a text's strongest evidence gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, stored

SIZE = 28  # a-z, border, any other letter
BITS = 20
_SHIFT = 32 - BITS
MAX_TRAIN = 20_000
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SIGN, SOFT = "@$!|+(€", "!|+("  # signs among them; those that also stand at the edges of words
_ONE = rf"(?:[^\W_]|[{SIGN}])"
SPACED = re.compile(rf"(?<![^\W_])(?<!\w['’]){_ONE}(?:[\s._*-]+{_ONE}){{2,}}(?![{SIGN}]*[^\W_])")
GAP = re.compile(r"[\s._*-]+")
LONE = "aeiouy"  # letters that are words
_DOUBLE = re.compile(r"(.)\1")
CHANNEL, DROP = 1.0, 0.7


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.where((points >= 97) & (points <= 122), points - 97, np.where(points > 127, 27, 26))
    return codes


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of character c behind a, b: trigrams of all texts, summed up by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    c = _codes(f" {text.lower()} ")
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3) if len(c) > 400 else 0
                    if len(c) <= 400:
                        np.add.at(total, (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    grams = docs.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 28 ** 3 rows
    table = np.full(SIZE**3, 0.1)
    for g in grams:
        table[g["gram"]] += g["n"]
    table = table.reshape(SIZE, SIZE, SIZE)
    return np.log(table / table.sum(axis=2, keepdims=True))


def restore(token: str, model: list, separated: bool = False, words: bool = False) -> str:
    """The likeliest letters behind a stretch: each sign is a letter it may stand for or is dropped; a letter that
    repeats the last one may be dropped. With ``words`` a gap may end a word (a space in the result)."""
    token = token.lower()
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(26, 26): (0.0, None)}  # texts are chains (before, letters)
    last = len(token)
    if token.isalpha() and (pairs := [m.start() for m in _DOUBLE.finditer(token)]):  # what stands before and behind them is sure
        a, b = ([26] + [ord(x) - 97 if "a" <= x <= "z" else 27 for x in token[: pairs[0] + 1]])[-2:]
        beams, token = {(a, b): (0.0, (None, token[: pairs[0] + 1]))}, token[pairs[0] + 1 :]
        last = pairs[-1] - pairs[0] + 1
    for at, ch in enumerate(token):
        if at > last and len(beams) == 1:
            beams = {state: (cost, (text, token[at:])) for state, (cost, text) in beams.items()}
            break
        gap = separated and (ch in "._*-" or ch.isspace())
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        if ch.isalpha():  # the letter itself, or none where it repeats the last one
            c = ord(ch) - 97 if "a" <= ch <= "z" else 27
            for state, (cost, text) in beams.items():
                b = state[1]
                kept, one = cost - model[state[0]][b][c], new.get((b, c))
                if one is None or kept < one[0]:
                    new[b, c] = (kept, (text, ch))
                if text and text[1][-1] == ch:
                    one = new.get(state)
                    if one is None or cost + DROP < one[0]:
                        new[state] = (cost + DROP, text)
            beams = new
            continue

        def put(state: tuple[int, int], cost: float, text: tuple | None, to: dict = new) -> None:
            if state not in to or cost < to[state][0]:
                to[state] = (cost, text)

        for (a, b), (cost, text) in beams.items():
            now = model[a][b]
            for x in LEET.get(ch, ""):
                c = ord(x) - 97
                put((b, c), cost + CHANNEL - now[c], (text, x))
                if text and text[1][-1] == x:
                    put((a, b), cost + DROP, text)
            put((a, b), cost + (0.1 if gap else 2.5), text)
            if words and gap and b != 26:
                put((b, 26), cost - now[26], (text, " "))
        beams = new
    _, text = min(((cost - model[a][b][26], text) for (a, b), (cost, text) in beams.items()), key=lambda x: x[0])
    letters = []
    while text:
        text, x = text
        letters.append(x)
    return "".join(reversed(letters))


_OUTER = "\"#%&')*,-./:;<=>?[\\]^`{}~"  # signs that stand for no letter: words_in() finds the same with and without them at the edges
_EDGE = re.compile(r"^\W+|\W+$")
_BORDERS = [re.compile(rf"^[^\w{x}]+|[^\w{x}]+$") for x in (SIGN, "".join(x for x in SIGN if x not in SOFT))]


def words_in(raw: str, model: list) -> set[str]:
    """The words of a stretch without white space and what it restores to."""
    if raw.isalpha():
        return {raw, restore(raw, model, True)} if _DOUBLE.search(raw) else {raw}
    plain = _EDGE.sub("", raw)
    out = {plain} if plain.isalpha() else {x for x in re.split(r"\W+", raw) if x.isalpha()}
    for core in {x.sub("", raw) for x in _BORDERS}:
        if any(c.isalpha() for c in core) and (_DOUBLE.search(core) or not core.isalpha()) and all(c in LEET or c.isalpha() or c in "._*-" for c in core):
            out.add(restore(core, model, True))
    return out


def words_apart(run: str, model: list) -> set[str]:
    """What single letters and signs with gaps restore to: one word, the likeliest words, and what stands behind each
    letter that is a word by itself."""
    out: set[str] = set()
    whole = GAP.sub(" ", run)
    for core in {whole, whole.strip(SOFT + " ")}:
        one = restore(core, model, True)
        out.update([one, *restore(core, model, True, True).split()])
        out.update(one[k + 1 : k + 41] for k, x in enumerate(one) if x in LONE)  # no word is longer
    return out


def features(word: str) -> list[int]:
    """Hashed prefixes of 4 to 7 letters and the whole word."""
    if len(word) < 3:
        return []
    return [zlib.crc32(word[:k].encode()) >> _SHIFT for k in range(4, min(8, len(word)))] + [zlib.crc32(f"{word}$".encode()) >> _SHIFT]


def _evidence(text: str | None, model: list, known: dict[str, tuple[int, ...]], of: Callable[[str], list[int]] = features) -> np.ndarray:
    """Features of a text's words, as ``of`` gives them; ``known`` keeps those of stretches seen before."""
    low = (text or "").lower()
    stretches = {raw.strip(_OUTER) for raw in set(low.split())}
    if len(known) > 200_000:
        known.clear()
    for raw in stretches.difference(known):
        known[raw] = tuple([f for w in words_in(raw, model) for f in of(w)])
    found: set[int] = set().union(*filter(None, map(known.__getitem__, stretches)))
    for run in {m[0] for m in SPACED.finditer(low)}:
        found.update(f for w in words_apart(run, model) for f in of(w))
    return np.fromiter(found, np.int64, len(found))


def _odds(bad: np.ndarray, good: np.ndarray, n1: float, n0: float) -> np.ndarray:
    p, m = n1 / max(1.0, n1 + n0), 5.0
    return np.log((bad + m * p + 1e-9) / (good + m * (1 - p) + 1e-9)) - math.log((p + 1e-9) / (1 - p + 1e-9))


def _summary(odds: np.ndarray) -> tuple[float, float]:
    top = -np.sort(-odds)[:2] if len(odds) else np.zeros(0)
    return float(max(0.0, top[0])) if len(top) else 0.0, float(max(0.0, top[1])) if len(top) > 1 else 0.0


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def _learn(docs: DataFrame, labels: DataFrame, max_train: int) -> Callable[[list, dict], list[float]]:
    """A function from texts (and the stretches seen before) to scores."""
    model = language_model(docs).tolist()
    chosen = labels.filter("doc_id is not null and toxic is not null").filter(_fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int64"), "at": [_evidence(t, model, known) for t in batch["text"]]})

    traits = stored(rows.mapInPandas(extract, "toxic long, at array<bigint>"), "traits")
    sums = {r["toxic"]: r["count"] for r in traits.groupBy("toxic").count().collect()}
    n1, n0 = float(sums.get(1, 0)), float(sums.get(0, 0))
    bad, good = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    counted = traits.select("toxic", F.explode("at").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    for r in counted.filter("bad > 0").toLocalIterator():  # at most 2 ** 20 rows
        bad[r["f"]], good[r["f"]] = r["bad"], r["good"]

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, at in zip(batch["toxic"], batch["at"], strict=True):
                at = np.asarray(at, np.int64)
                seen = bad[at] > y  # a text's own count is left out
                out.append((y, *_summary(_odds(bad[at] - y, good[at] - (1 - y), n1, n0)[seen])))
            yield pd.DataFrame(out, columns=["y", "a", "b"]).astype({"y": "int64", "a": "float64", "b": "float64"})

    fit = traits.mapInPandas(summaries, "y long, a double, b double").toPandas().to_numpy()  # at most max_train rows
    discard(traits)
    weights = np.array([-3.0, 1.0, 0.2]) if len(fit) else np.array([-50.0, 0.0, 0.0])
    if len(fit):
        x, y = np.column_stack([np.ones(len(fit)), fit[:, 1:]]), fit[:, 0]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(3)
            weights = weights - np.linalg.solve(curve, x.T @ (p - y) + 1e-2 * weights)
    odds = np.where(bad > 0, _odds(bad, good, n1, n0), -1).astype(np.float32)
    counts = (odds > 0).tobytes()

    def telling(word: str) -> list[int]:
        """Features that raise a score: few words have any, and no others count."""
        return [f for f in features(word) if counts[f]]

    def score(texts: list, known: dict) -> list[float]:
        out = []
        for text in texts:
            a, b = _summary(odds[_evidence(text, model, known, telling)])
            out.append(1 / (1 + math.exp(-float(np.clip(weights @ np.array([1.0, a, b]), -50, 50)))))
        return out

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from at most ``max_train`` labelled ids (lowest hashes) whose crc32 mod 5 is not 0. Null and empty texts get
    the score of a text without evidence. Repeated label rows and copies of a text count once, with the higher label; null
    labels are left out; without labels all scores are under 1e-20. An empty table gives none. The model that goes with the tasks has 2 ** 20 odds and 28 ** 3 trigrams at most.
    """
    scores = _learn(docs, labels, max_train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1).to_pylist(), known), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that ``score_toxicity`` does not reject, each judged by its own text."""
    scores = _learn(docs, labels, max_train)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([x < 0.5 for x in scores(texts, known)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
