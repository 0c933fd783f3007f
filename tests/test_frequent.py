"""Most asked questions: bounded summaries, the proof, and the second pass where it fails."""

import random
from collections import Counter

import pytest

from railweave.operators import quality as ql
from railweave.sources import tables


def log(spark, kind):
    rng = random.Random(8)
    if kind == "few":  # a few questions hold most rows
        texts = [f"Common {rng.randrange(8)}" if rng.random() < 0.7 else f"rare {rng.randrange(10**6)}" for _ in range(8000)]
    else:  # all are about equally rare, so no bounded summary can tell
        texts = [f"even {rng.randrange(2500)}" for _ in range(8000)]
    texts += [None, None, "  COMMON 1 ", "x" * 150 + "a", "x" * 150 + "b"]
    rows = [(t, i) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "question string, ts long").repartition(4)


def brute(rows, n):
    counts, first = Counter(), {}
    for text, ts in rows:
        key = (text or "").lower().strip(" ")
        counts[key] += 1
        first[key] = min(ts, first.get(key, ts))
    return [(q, counts[q], first[q]) for q in sorted(counts, key=lambda q: (-counts[q], first[q], q))[:n]]


@pytest.mark.parametrize("kind", ["few", "even"])
def test_top_questions_are_exact(spark, kind):
    rows, df = log(spark, kind)
    assert [tuple(r) for r in ql.top_questions(df, 6, size=64).collect()] == brute(rows, 6)
    assert ql.top_questions(df.limit(0), 6).collect() == []


def test_summary_bounds(spark):
    rows, df = log(spark, "few")
    summary = ql.frequent_values(df, "question", 64).collect()
    lost, low, counts = sum(r.lost for r in summary), Counter(), Counter(t for t, _ in rows)
    for r in summary:
        if not r.of_task:
            low[r.value] += r.low
    assert len(summary) <= 4 * 66 and 0 < lost
    assert all(low[t] <= n <= low[t] + lost for t, n in counts.items())


def test_whole_questions_and_missing_collections(spark, tmp_path):
    rows, df = log(spark, "few")
    assert tables.log_records(df).where("length(question) = 151").count() == 2 and tables.log_records(df, 200).where("length(question) = 151").count() == 2
    assert tables.log_records(df, 100).where("length(question) > 100").count() == 0
    schema, root = "collection string, doc_id long, content string", str(tmp_path / "store")
    first = spark.createDataFrame([("a", 1, "x"), (None, 1, "n"), (None, 1, "n"), ("a", None, "m")], schema)
    assert tables.append_missing(first, root).count() == 3
    assert sorted((r.collection or "", r.doc_id or 0) for r in tables.append_missing(spark.createDataFrame([("a", 1, "x"), (None, 1, "n"), (None, 2, "n"), ("b", 1, "y"), ("a", None, "m")], schema), root).collect()) == [("", 2), ("b", 1)]
    assert spark.read.parquet(root).count() == 5
