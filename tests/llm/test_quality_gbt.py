"""Base counts against a plain count, trees against their constraints."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import WORD, prose

from railweave.llm import quality_gbt as qg


def brute(text):
    x = text or ""
    w = WORD.findall(x)
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
    seen, repeated = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), repeated, len(cover)]


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=" \n\tabé#|\x1f ", max_size=80))
def test_counts(text):
    assert qg.statistics(text)[0] == brute(text)


def test_odd_rows(make, odd_rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")
    docs = make(odd_rows)
    got = qg.judge(docs, qg.fit(docs, labels)).collect()
    want = sorted((d, *brute(t)) for d, t, _, _ in odd_rows if d is not None)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r.doc_id is not None) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert qg.judge(make([]), qg.train(np.zeros((0, len(qg.FEATURES))), np.zeros(0))).collect() == []


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(qg.FEATURES)))
    symbols, repeats = qg.FEATURES.index("symbol_share"), qg.FEATURES.index("repeat_share")
    good = (x[:, symbols] + 0.3 * x[:, repeats] + 0.2 * np.sin(12 * x[:, 1]) + 0.1 * rng.normal(size=3000) < 0.7).astype(float)
    return x, good, qg.train(x, good)


def test_learns(sample):
    x, good, forest = sample
    assert ((forest.chance(x) > 0.5) == (good > 0.5)).mean() > 0.9


def test_monotone(sample):
    x, _, forest = sample
    for name, direction in qg.MONOTONE.items():
        f = qg.FEATURES.index(name)
        rows = np.repeat(x[:50], 40, axis=0)
        rows[:, f] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
        steps = np.diff(forest.chance(rows).reshape(50, 40), axis=1)
        assert (direction * steps >= -1e-12).all(), name


def test_flat_arrays_equal_a_walk_down_each_tree(sample):
    x, _, forest = sample
    for row in x[:20]:
        total = forest.start
        for root in forest.roots:
            node = root
            while forest.feature[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.cut[node] else forest.right[node]
            total += forest.value[node]
        assert abs(forest.chance(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_junk_goes_and_prose_stays(make, spark):
    rows = [(k, " ".join(prose(k, 60)), "a", "s") if k % 2 else (k, " ".join(f"{w}### |" for w in prose(k, 60)), "a", "s") for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 300)], "doc_id long, quality int")
    docs = make(rows)
    got = {r.doc_id: r.kept for r in qg.judge(docs, qg.fit(docs, labels)).collect()}
    assert np.mean([got[k] == bool(k % 2) for k in range(300, 400)]) > 0.97
