import contextlib
import random
import time

import numpy as np

from strata.llm import toxicity, training_order


def _model():
    return np.log(np.random.default_rng(3).dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).tolist()


def test_signs_at_the_edges_do_not_decode_a_word_again(monkeypatch):
    model, asked, plain = _model(), [], toxicity.words_in
    monkeypatch.setattr(toxicity, "words_in", lambda raw, m: asked.append(raw) or plain(raw, m))
    found = toxicity._evidence('letter letter, "letter" letter... [letter] -letter*', model, {})
    assert asked == ["letter"]
    assert set(found) == {f for w in plain("letter", model) for f in toxicity.features(w)}


def test_evidence_against_every_stretch_on_its_own():
    model, rng = _model(), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aabbeellioosst  01345@$!|+(€._*-'\"#%éß中,;:?)[]{}~^`\\/&<>=²½ªⅷ") for _ in range(rng.randint(0, 40)))
        want = {f for raw in text.split() for w in toxicity.words_in(raw, model) for f in toxicity.features(w)}
        want |= {f for m in toxicity.SPACED.finditer(text) for w in toxicity.words_apart(m[0], model) for f in toxicity.features(w)}
        assert set(toxicity._evidence(text, model, {})) == want
        assert set(toxicity._evidence(text, model, {}, lambda w: [f for f in toxicity.features(w) if f % 3])) == {f for f in want if f % 3}


def test_shards_leave_no_shuffle_files_and_rounds_change_nothing(spark, monkeypatch):
    def kept():
        return set(spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().keySet().mkString(",").split(","))

    docs = spark.range(900).selectExpr("id AS doc_id", "repeat(concat('some words of text ', id, ' '), cast(id % 40 AS int)) AS text").repartition(3)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, rows, left = spark.conf.get(name), [], []
    for rounds in (1, 4):
        monkeypatch.setattr(training_order, "ROUNDS", rounds)
        moved, plain = [], training_order.brief_shuffles

        @contextlib.contextmanager
        def watched(session):
            before = kept()
            with plain(session):
                yield
            for _ in range(50):  # files are deleted in the background
                if not (after := kept() - before):
                    break
                time.sleep(0.1)
            moved.append(after)

        with monkeypatch.context() as m:
            m.setattr(training_order, "brief_shuffles", watched)
            rows.append(sorted(map(tuple, training_order.materialise(docs, length=32, per_shard=64).collect())))
        left += moved
    assert rows[0] == rows[1] and [r[0] for r in rows[0]] == list(range(len(rows[0]))) and len(rows[0]) > 1000
    assert left == [set()] * 2 and spark.conf.get(name) == setting
