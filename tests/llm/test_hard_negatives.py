"""Mined negatives against a walk over all pairs, and the bounds that spare pairs."""

import math
import random

import numpy as np
import pytest

from railweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, v string, mean string, dev string, score string, rank string, across string, down string, anchor_id string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *("x",) * 9) for r in rows], SCHEMA)


def brute(rows, every=100, k=5, m=10):
    known = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        scaled = [max(-hn.MOST, min(hn.MOST, math.floor(256 * float(np.float32(x))))) for x in vector]
        known[i] = min(known.get(i, (label, scaled)), (label, scaled))
    out = []
    for a in sorted(i for i in known if i % every == 0):
        scores = {b: sum(x * y for x, y in zip(known[a][1], known[b][1])) for b in known if b != a}
        ranked = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in ranked if known[b][0] == known[a][0]][:k]:
            fit = [b for b in ranked if known[b][0] != known[a][0] and 30 * scores[p] <= 100 * scores[b] <= 90 * scores[p]]
            out += [(a, p, rank, b, scores[p], scores[b]) for rank, b in enumerate(fit[:m], 1)]
    return sorted(out)


def run(spark, rows, **options):
    got = hn.mine(table(spark, rows), **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n, d=12, labels=4, spread=0.4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(3, d))
    return [(int(i), (centers[rng.integers(3)] + spread * rng.normal(size=d)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("d", [1, 7, 12, 64])
def test_all_pairs(spark, d):
    rows = vectors(d, 300, d)
    assert run(spark, rows, every=9) == brute(rows, every=9) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(5, 120) + [(200, None, 1), (210, [1.0, None], 1), (220, [nan] * 12, 1), (230, [inf] + [0.0] * 11, 1), (240, [1.0] * 12, None), (None, [1.0] * 12, 1),
                              (250, [], 1), (260, [2.0], 1), (270, [0.0] * 12, 2), (280, [3e38] * 12, 2), (290, [-3e38] * 12, 1),
                              (300, [0.5] * 12, 1), (300, [0.5] * 12, 1), (300, [0.25] * 12, 0), *((400 + k, [0.75] * 12, k % 3) for k in range(40))]
    assert run(spark, rows, every=10) == brute(rows, every=10) != []


def test_one_label_and_one_vector_hold_most_rows(spark):
    """More rows than a block in one label, a third of them equal: ties go by id across blocks."""
    rng = random.Random(7)
    rows = [(i, [1.0, 0.5, 0.25, 0.0] if i % 3 else [round(rng.random(), 2) for _ in range(4)], 0 if i % 5 else 1 + i % 4) for i in range(6000)]
    assert run(spark, rows, every=500) == brute(rows, every=500) != []


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and run(spark, [(100, [1.0], 1), (1, [1.0], 2)]) == []


def block(left, right):
    return hn.Block((left, *map(lambda x: x.astype(np.float32).astype(float), hn.summaries(left))), (right, *map(lambda x: x.astype(np.float32).astype(float), hn.summaries(right))))


@pytest.mark.parametrize("size", [3, 1 << 10, 1 << 26])
def test_bounds_hold_at_every_level(size):
    rng = np.random.default_rng(size)
    left, right = (rng.integers(-size, size + 1, (n, 64)) for n in (20, 300))
    left[0], right[0] = size, -size
    b = block(left, right)
    exact, last = left @ right.T, None
    for level in range(len(b.a_levels)):
        alive, low, high = np.ones((20, 300), bool), np.full((20, 300), -np.inf), np.full((20, 300), np.inf)
        b.bounds(level, alive, low, high)
        assert (low <= exact).all() and (exact <= high).all()
        assert last is None or (high - low).mean() <= last + 1
        last = (high - low).mean()
        thin = np.zeros((20, 300), bool)
        thin[:, ::100] = True  # pair by pair
        low2, high2 = np.full((20, 300), -np.inf), np.full((20, 300), np.inf)
        b.bounds(level, thin, low2, high2)
        assert np.allclose(low2[thin], low[thin]) and np.allclose(high2[thin], high[thin])
    assert (b.exact(np.ones((20, 300), bool)) == exact).all()


def test_smooth_vectors_are_seldom_scored():
    """Where neighbouring components are alike, the bounds settle nearly all pairs, and the lists stay right."""
    rng = np.random.default_rng(11)
    smooth = lambda n: np.floor(256 * (np.repeat(rng.normal(size=(n, 8)), 8, axis=1) + 0.02 * rng.normal(size=(n, 64)))).astype(np.int64)
    left, right = smooth(50), smooth(2000)
    b = block(left, right)
    rows, columns, scores = hn.positives_of(b, np.ones((50, 2000), bool), 5)
    assert b.scored < 0.05 * 50 * 2000
    exact = left @ right.T
    want = [sorted(range(2000), key=lambda j: (-exact[i, j], j))[:5] for i in range(50)]
    assert [columns[rows == i].tolist() for i in range(50)] == want and (scores == exact[rows, columns]).all()
