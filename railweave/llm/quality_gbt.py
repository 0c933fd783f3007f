"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled documents, with splits on
histogram bins. Chosen features are monotone: a split against the asked direction is
not taken, and the bounds of a split's middle hold for all leaves below it. The forest
is flattened into node arrays, and all documents of a batch go down all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm.common import hash_cut, mix64, scan, word_hashes

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: Labelled documents in the training sample.
SAMPLE_DOCS = 4000
TREES, DEPTH, BINS, RATE, MIN_LEAF, SMOOTH = 60, 4, 64, 0.2, 20, 1.0
#: The trees keep a document unless its chance of good quality is below this.
THRESHOLD = 0.5
#: Base counts that the contract names, then ratios and further statistics that the trees use.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "distinct_share", "line_words", "end_share"]
#: 1: more is never worse, -1: more is never better, 0: free.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(base counts, features) of a whole text; zeros for null and for a text without words."""
    coded = (text or "").encode()
    data = np.frombuffer(coded, np.uint8)
    start, hashes = word_hashes(coded)
    n = len(hashes)
    if not n:
        return [0, 0, int(_SYMBOL[data].sum()), 0, 0], [0.0] * len(FEATURES)
    symbols = int(_SYMBOL[data].sum())
    chars = int((((data & 0xC0) != 0x80) & ~_SPACE[data]).sum())
    lines = [x for x in coded.split(b"\n") if x.strip()]
    repeated_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= WINDOW:
        window = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            window = mix64(window * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(window)])
        order = np.argsort(window, kind="stable")
        ranked = window[order]
        same = np.zeros(len(ranked), bool)
        same[1:] = ranked[1:] == ranked[:-1]
        same[:-1] |= ranked[:-1] == ranked[1:]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, order[same], 1)
        np.add.at(cover, order[same] + WINDOW, -1)
        repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    upper = int(((data >= 65) & (data <= 90)).sum())
    digits = int(((data >= 48) & (data <= 57)).sum())
    ends = int(np.isin(data, (33, 46, 63)).sum())
    features = [float(np.log1p(n)), chars / n, symbols / chars, repeated_lines / len(lines), repeat / n, upper / chars, digits / chars,
                len(np.unique(hashes)) / n, n / len(lines), ends / n]
    return [n, chars, symbols, repeated_lines, repeat], features


@dataclass
class Forest:
    """Node arrays of all trees: feature (-1: leaf), cut, left, right, value; roots of the trees."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Chance of good quality for each row; all trees go down a level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            feature = self.feature[node]
            below = np.where(x[rows, np.maximum(feature, 0)] <= self.cut[node], self.left[node], self.right[node])
            node = np.where(feature >= 0, below, node)
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def train(x: np.ndarray, good: np.ndarray) -> Forest:
    """Logistic boosting. Without rows, or with one class only, every chance is that class's share (1 without rows)."""
    share = float(np.clip(good.mean(), 1e-3, 1 - 1e-3)) if len(good) else 1 - 1e-3
    start = float(np.log(share / (1 - share)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(FEATURES)), np.int64)
    direction = [MONOTONE.get(name, 0) for name in FEATURES]
    margin = np.full(len(good), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + SMOOTH), low, high))

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        me = len(feature)
        for column, default in ((feature, -1), (cut, 0.0), (left, me), (right, me), (value, 0.0)):
            column.append(default)
        g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
        value[me] = RATE * leaf(g_all, h_all, low, high)
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                g, h, n = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (gradient[rows], hessian[rows], None))
                gain = g**2 / (h + SMOOTH) + (g_all - g)**2 / (h_all - h + SMOOTH) - g_all**2 / (h_all + SMOOTH)
                a, c = np.clip(g / (h + SMOOTH), low, high), np.clip((g_all - g) / (h_all - h + SMOOTH), low, high)
                gain = np.where((n >= MIN_LEAF) & (len(rows) - n >= MIN_LEAF) & (direction[f] * (c - a) >= 0), gain, 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, (a[k] + c[k]) / 2))
        if best[1]:
            f, k, middle = best[1]
            smaller = binned[rows, f] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[direction[f]]
            feature[me], cut[me] = f, float(edges[f][k])
            left[me] = grow(rows[smaller], depth + 1, *bounds[0])
            right[me] = grow(rows[~smaller], depth + 1, *bounds[1])
        return me

    if 0 < good.sum() < len(good):
        every = np.arange(len(good))
        for _ in range(TREES):
            chance = 1 / (1 + np.exp(-margin))
            gradient, hessian = good - chance, chance * (1 - chance)
            root = grow(every, 0, -np.inf, np.inf)
            roots.append(root)
            node = np.full(len(good), root)
            for _ in range(DEPTH):
                f = np.array(feature)[node]
                node = np.where(f >= 0, np.where(x[every, np.maximum(f, 0)] <= np.array(cut)[node], np.array(left)[node], np.array(right)[node]), node)
            margin = margin + np.array(value)[node]
    return Forest(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), start)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Forest:
    """Learn from the labelled documents whose hashed ids come first; labels or texts that are null are not used."""
    label = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("double").alias("good")).dropna().groupBy("doc_id").agg(F.max("good").alias("good"))
    chosen = label.filter(hash_cut(label.select("doc_id"), "doc_id", sample_docs))
    # at most sample_docs rows of 16 bytes
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        features = [statistics(x)[1] for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(features, pa.list_(pa.float64()))], ["doc_id", "good", "features"])

    rows = sorted(((r["doc_id"], r["good"], *r["features"]) for r in scan(sample, run, "doc_id long, good double, features array<double>").collect()))
    x = np.array([r[2:] for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r[1] for r in rows]))


def judge(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base counts, base_failed, kept, chance (of good quality).

    A null text has no words and fails the base rules. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(x) for x in batch.column("text").to_pylist()]
        base = np.array([b for b, _ in both], np.int64).reshape(len(both), len(BASE))
        chance = shared.value.chance(np.array([f for _, f in both]).reshape(len(both), len(FEATURES)))
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED * base[:, 0])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[:, k].copy()) for k in range(len(BASE))), pa.array(failed), pa.array(~failed & (chance >= THRESHOLD)), pa.array(chance)],
                                          ["doc_id", *BASE, "base_failed", "kept", "chance"])

    schema = f"doc_id long, {', '.join(f'{x} long' for x in BASE)}, base_failed boolean, kept boolean, chance double"
    return scan(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)
