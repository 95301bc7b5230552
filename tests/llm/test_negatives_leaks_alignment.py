import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import alignment, decontaminate, hard_negatives

NAN, INF = float("nan"), float("inf")


# --- hard negatives ---------------------------------------------------------------------------------------------------


def mined(rows, every=100, positives=5, negatives=10, least=30, most=90, scale=256):
    """All pairs, in plain Python."""
    sound = [(i, label, tuple(int(np.floor(scale * x)) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < INF for x in v)]
    out = []
    for a, (i, label, q) in enumerate(sound):
        if i % every:
            continue
        met = [(-sum(x * y for x, y in zip(q, v)), j, own == label) for b, (j, own, v) in enumerate(sound) if a != b and len(v) == len(q)]
        for p, j, _ in sorted(m for m in met if m[2])[:positives]:
            hits = sorted(m for m in met if not m[2] and least * -p <= 100 * -m[0] <= most * -p)[:negatives]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(hits, 1)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, score string, row int")


def check(spark, rows, **settings):
    got = hard_negatives.mine(vectors(spark, rows), **settings).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    given = {k: v for k, v in settings.items() if k != "anchors"}
    assert Counter(tuple(r[n] for n in names) for r in got) == mined(rows, **given)
    return len(got)


def test_negatives_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8))
    # lengths over three powers of ten, so buckets differ; half of all rows have one label, and labels overlap
    rows = [(i, (centres[k] + rng.normal(size=8)).tolist() if i % 3 else (centres[k] * 10 ** rng.uniform(-1, 2)).tolist(), int(k)) for i, k in ((i, int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(700))]
    assert check(spark, rows, every=10) > 500
    assert check(spark, rows, every=10, anchors=16, positives=2, negatives=3) > 100  # several blocks of anchors


def test_negatives_of_awkward_vectors(spark):
    rows = [(None, [1.0, 1.0], 1), (0, None, 1), (100, [1.0, None], 1), (200, [NAN, 1.0], 1), (300, [INF, 1.0], 1), (400, [1.0, 1.0], None)]
    assert check(spark, rows) == 0
    rows += [(0, [0.0, 0.0], 1), (0, [2.0, 1.0], 1), (0, [2.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 2), (2, [1.0, 0.5], 2), (3, [0.1, 0.1], 2), (4, [-1.0, 0.0], 2), (100, [1.0, 2.0, 3.0], 1), (5, [1.0, 2.0, 3.0], 1), (6, [0.5, 1.0, 1.5], 2), (200, [], 3), (7, [], 3), (8, [], 4)]
    assert check(spark, rows) > 10  # repeated ids, ties, zero and empty vectors, two widths
    rows += [(1000 + i, [1.0, 1.0], i % 2) for i in range(0, 400)]  # one vector many times
    check(spark, rows)
    assert hard_negatives.mine(vectors(spark, [])).count() == 0


def test_focus_coordinates_keep_all_that_reach_the_cosine():
    rng = np.random.default_rng(6)
    p = rng.normal(size=(500, 6)) * rng.uniform(0.1, 3, size=(500, 1))
    norms = np.linalg.norm(p, axis=1)
    bucket = hard_negatives.Bucket(p, norms, np.arange(500), np.arange(500), 0)
    kept = 0
    for q in rng.normal(size=(40, 6)):
        for local in (0.6, 0.8, 0.95):
            at = bucket.feasible(q, np.linalg.norm(q), local)
            need = np.flatnonzero(p @ q >= local * np.linalg.norm(q) * norms)
            assert set(need) <= set(at)
            kept += len(at)
    assert kept < 500 * 120 / 2  # and cut most of the others


# --- decontamination --------------------------------------------------------------------------------------------------


def leaks(texts, items):
    """Words, hit words and items of each text, window by window."""
    words = lambda t: re.findall(decontaminate.WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = []
    for t in texts:
        w, hit, which = words(t), set(), set()
        for item, text in items:
            b = words(text)
            k = min(10, len(b))
            if item is None or not k:
                continue
            parts = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in parts:
                    hit |= set(range(i, i + k))
                    which.add(str(item))
        spans = [i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]
        found.append((len(w), list(zip(*spans)), sorted(which)))
    return found


def tables(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in texts], "doc_id long, text string, window string, spans int")
    return docs, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("most", [1 << 20, 1000])
def test_leaks_against_plain_search(spark, most):
    rng = random.Random(7)
    vocabulary = ["a", "b", "the", "x1", "Über", "日本", "longerword", "ZZ", "q" * 300]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " -- ", "\x00", "_"]) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([25, 12, 10, 9, 4, 3, 40, 0, 30, 30])] + [(None, say(12)), (3, say(2)), (50, None), (51, "..."), (52, "Single")]
    texts = []
    for i in range(150):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            source = (items[rng.randrange(len(items))][1] or "").split(" ")
            low = rng.randint(0, max(0, len(source) - 1))
            parts += [" ".join(source[low : low + rng.randint(1, 20)]).upper() if rng.random() < 0.3 else " ".join(source[low:]), say(rng.randint(0, 4))]
        texts.append((i, " ".join(parts)))
    texts += [(None, items[0][1]), (3, items[0][1]), (900, None), (901, ""), (902, "single"), (903, "singles single-minded")]
    docs, bench = tables(spark, texts, items)
    rows = decontaminate.decontaminate(docs, bench, most=most).collect()
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(s) for s in r["spans"]), tuple(r["items"])) for r in rows)
    want = Counter((i, n, tuple(s), tuple(w)) for (i, _), (n, s, w) in zip(texts, leaks([t for _, t in texts], items)))
    assert got == want and any(w for _, _, _, w in got)


def test_leaks_in_long_texts_and_empty_tables(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(400_000)]  # 2.4 MB
    passage = [f"p{k}" for k in range(60)]
    text = " ".join([*passage[:30], *words, *passage[5:40], *words[:10], *passage[-11:]])
    docs, bench = tables(spark, [(1, text), (2, " ".join(words))], [(7, " ".join(passage))])
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert [tuple(s) for s in rows[1]["spans"]] == [(0, 30), (400_030, 400_065), (400_075, 400_086)] and rows[1]["items"] == ["7"]
    assert rows[2]["spans"] == [] and rows[2]["n_words"] == 400_000
    none = decontaminate.decontaminate(docs, bench.limit(0)).collect()
    assert {r["doc_id"]: (r["n_words"] > 0, r["items"]) for r in none} == {1: (True, []), 2: (True, [])}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


# --- alignment --------------------------------------------------------------------------------------------------------


def plain(both, text):
    """Counts, groups and links of a whole text, token by token."""
    whole = f" {text}".encode()
    ids = [both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)] if text else [[], []]
    tokens = [[table[i] for i in x] for table, x in zip((both.bytes_a, both.bytes_b), ids)]
    if not text or any(b"".join(t) != whole for t in tokens):
        return None
    ranges = []
    for side in tokens:
        at = np.append(0, np.cumsum([len(t) for t in side])).tolist()
        ranges.append(list(zip(at, at[1:])))
    shared = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    groups = [["".join(f"{i}," for i, (_, e) in zip(x, r) if low < e <= high)[:-1] for x, r in zip(ids, ranges)] for low, high in zip([0, *shared], shared)]
    links = Counter((i, j) for i, p in zip(ids[0], ranges[0]) for j, q in zip(ids[1], ranges[1]) if max(p[0], q[0]) < min(p[1], q[1]))
    return len(ids[0]), len(ids[1]), len(shared), ";".join("|".join(g) for g in groups), links


PIECES = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "日", "本", "𐍈", "ß", "1", "23", ".", "!!", "<|endoftext|>", "</s>", " ", "　", "’s", "'s", "▁", "<0x41>", "\r\n", "ﬁ", "é", "\x00", "ing", "x" * 60]


@pytest.mark.parametrize("pairs", [1 << 21, 40])
def test_alignment_against_whole_texts(spark, pairs):
    import public_tokenizers

    rng = random.Random(9)
    texts = [None, "", " ", "a ", " a", "\n", "\n ", "a\n b", "▁", "the the the"] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(300)] + ["the the the"] * 5
    rows = [(None if k == 20 else k % 200, t, 5, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, keys string")
    both = alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = [plain(both, t) for t in texts]
    held = Counter(pair for f in found if f for pair in f[4])
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    want = Counter()
    for (doc, *_), f in zip(rows, found):
        if f is None:
            want[doc, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        links = f[4]
        best = sum(n for (i, j), n in links.items() if held[i, j] == top[i])
        want[doc, *f[:3], sum(links.values()), best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(f[3].encode()).hexdigest()] += 1
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = Counter(tuple(r[n] for n in names) for r in alignment.align(docs, pairs=pairs).collect())
    assert got == want and sum(f is None for f in found) > 20


def test_alignment_of_long_and_no_texts(spark):
    rng = random.Random(10)
    long = " ".join("".join(rng.choice("abcdefgh日é") for _ in range(rng.randint(1, 9))) for _ in range(300_000))  # 2 MB
    docs = spark.createDataFrame([(1, long), (2, "x" * 200_000), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.align(docs).collect()}
    assert rows[1]["n_links"] == rows[1]["n_a"] + rows[1]["n_b"] - rows[1]["n_groups"] > 300_000
    assert rows[2]["n_groups"] > 0 and rows[3]["n_a"] == 0
    assert alignment.align(docs.limit(0)).count() == 0
    groups = alignment.aligned(docs.filter("doc_id = 2"), alignment.default_path(), __import__("public_tokenizers").path("piece_bpe_32k.model"), groups=True).select("groups", F.sha2("groups", 256).alias("h"), "groups_sha256").first()
    assert groups["h"] == groups["groups_sha256"] and groups["groups"].count(";") + 1 == rows[2]["n_groups"]
