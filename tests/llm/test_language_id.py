"""Held-out accuracy, rejection and what may be learned."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from railweave.llm import language_id as li
from railweave.llm.common import stratified

SOUNDS = {"xx": ["ka", "tu", "mi", "ro"], "yy": ["schl", "eng", "ung", "heit"], "zz": ["ção", "inho", "ã", "que"]}


def texts(n, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SOUNDS))
        out.append((k, " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_accuracy_on_held_out_rows(make):
    rows = texts(600)
    docs = make(rows)
    truth = {r[0]: r[2] for r in rows}
    got = li.predict(docs, li.fit(docs)).withColumn("held", li.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 80 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_seen(make):
    rows = texts(200)
    changed = [(d, t, "other" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in rows]
    a, b = li.fit(make(rows)), li.fit(make(changed))
    assert a.langs == b.langs and (a.logits == b.logits).all() and a.threshold == b.threshold


def test_odd_rows(make, odd_rows):
    docs = make(odd_rows)
    got = li.predict(docs, li.fit(docs)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (5, 6, 7, 14):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        elif r.doc_id is not None:
            assert r.lang_pred in ("a", "b")


def test_accepted_rows_keep_columns(make, odd_rows):
    docs = make(odd_rows)
    kept = li.accepted_only(docs, li.fit(docs))
    assert kept.schema == docs.schema
    assert {5, 6, 7, 14}.isdisjoint({r.doc_id for r in kept.collect()})


def test_nothing_to_learn(make):
    docs = make([(1, "some text", None), (2, None, "a"), (None, "more text", "a")])
    model = li.fit(docs)
    assert model.langs == [] and {r.lang_pred for r in li.predict(docs, model).collect()} == {"und"}
    assert li.predict(make([]), model).collect() == []


def test_threshold_rejects_what_is_often_wrong():
    rng = np.random.default_rng(1)
    model = li.Model(["a", "b"], np.array([[3.0, -3.0], [0.1, -0.1]] + [[0, 0]] * (li.BUCKETS - 2), np.float32), np.zeros(2))
    sure = [("a", np.array([0]), np.array([1.0]))] * 500
    unsure = [(("a", "b")[int(x)], np.array([1]), np.array([1.0])) for x in rng.integers(0, 2, 200)]
    li.calibrate(model, sure + unsure)
    sure_score, unsure_score = (li.softmax(model.logits[k] / model.temperature).max() for k in (0, 1))
    assert unsure_score < model.threshold <= sure_score + 1e-9


def test_wrong_labels_reject_no_clean_text(make):
    """3 % wrong labels: under 1 % of the documents are rejected."""
    rng = random.Random(5)
    rows = [(d, t, rng.choice(list(SOUNDS)) if rng.random() < 0.045 else lang) for d, t, lang in texts(3000, 3)]
    docs = make(rows)
    got = li.predict(docs, li.fit(docs)).collect()
    assert np.mean([not r.accepted for r in got]) < 0.01


def test_repeated_ids_and_rare_languages_are_learned(make):
    """One id, and one row, on five of six rows; a language on one row in 200."""
    rows = texts(600, 4)
    rare = [(10_000 + k, " ".join("wq" + "xj" * (1 + k % 3) for _ in range(20)), "rare") for k in range(60)]
    same = [(1, t, lang) for _, t, lang in texts(3000, 6)] + [(1, *texts(1, 7)[0][1:])] * 3000
    model = li.fit(make(rows + same + rare), train_docs=400, calibration_docs=200)
    assert model.langs == ["rare", *SOUNDS]
    got = li.predict(make(rows), model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_sample_is_bounded_and_even(make):
    docs = make([(k % 7, f"text {k % 900}", "a" if k % 50 else "b") for k in range(5000)] + [(1, "same", "a")] * 4000).select("doc_id", "text", "lang")
    got = stratified(docs, "lang", 300).collect()
    assert len(got) == len(set(got)) <= 300 and 18 <= sum(r.lang == "b" for r in got) and sum(r.lang == "a" for r in got) >= 150
    assert stratified(docs.limit(0), "lang", 10).collect() == []
