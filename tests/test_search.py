"""Search operators against brute force on small inputs."""

import random
import time
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave.operators import retrieve as rt
from railweave.operators import stations as st
from railweave.operators import vectors as vc

NAMES = ["vijayawada", "visakhapatnam", "hyderabad", "secunderabad", "new delhi", "old delhi", "chennai central", "guntur", "guntakal", "tirupati", "tenali"]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = set(NAMES)
    for name in NAMES:
        for _ in range(25):
            w = list(name)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(w))
                w[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "n", "dd"])
            words.add("".join(w))
    for cutoff in (0.8, 0.82):
        got = {(r.word, r.alias) for r in st.similar_pairs(
            spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in NAMES], "alias string"), cutoff).collect()}
        want = {(w, n) for w in words for n in NAMES if w and SequenceMatcher(None, n, w).ratio() >= cutoff}
        assert got == want


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(5)
    parts = ["SC", "NSC", "Guntur", "guntur", "Guntur Junction", "xGuntur Junctiony", "to", "Ne", "New Delhi", "NewDelhi", "(SC)", "é"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(80)]
    terms = ["SC", "Guntur", "Guntur Junction", "New Delhi", "Delhi", "é", "zz"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, content string, collection string")
    got = {(r.doc_id, r.term, r.same_case) for r in rt.contains_join(docs, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {(i, t, t in x) for i, x in enumerate(texts) for t in terms if t.lower() in x.lower()}
    assert got == want


def test_vector_topk_over_blocks(spark):
    rng = np.random.default_rng(1)
    q, d = rng.normal(size=(7, 8)), rng.normal(size=(90, 8))
    q, d = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, d))
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, embedding array<double>")
    documents = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(d)], "doc_id long, collection string, embedding array<double>")
    got = {(r.question_id, r.collection, r.doc_id) for r in vc.vector_topk(questions, documents, k=3, min_score=0.2, block_questions=2, block_documents=10).collect()}
    want = set()
    for i in range(7):
        for c in "ab":
            ids = [j for j in range(90) if "ab"[j % 2] == c and q[i] @ d[j] >= 0.2]
            want |= {(i, c, j) for j in sorted(ids, key=lambda j: (-round(float(q[i] @ d[j]), 4), j))[:3]}
    assert got == want


def test_l2_relevance(spark):
    v = spark.createDataFrame([(1, "c", [1.0, 0.0]), (2, "c", [0.0, 1.0])], "doc_id long, collection string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, embedding array<double>")
    assert [(r.doc_id, r.score) for r in vc.vector_topk(q, v, metric="l2_relevance").collect()] == [(1, 1.0)]


def test_rrf_counts_every_occurrence(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "x" * 100 + "a"), (4, "x" * 100 + "b")], "doc_id long, content string")
    ranked = spark.createDataFrame([(0, 0, 0, 1, 0.9), (0, 1, 0, 2, 0.8), (0, 1, 1, 1, 0.7), (0, 1, 2, 2, 0.8), (0, 2, 0, 3, 0.3), (0, 2, 1, 4, 0.4)],
                                   "question_id long, list_no int, rank int, doc_id long, score double")
    rows = rt.rrf_fuse(ranked, docs, prefix_len=100).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [(1, 0.9), (4, 0.4), (2, 0.8)]
    assert rows[0].rrf_score == round(1 / 61 + 1 / 62, 6)


def test_route_validation_and_direction(spark):
    text = "Train 1. From A to C. Stops (3): Alpha > Beta > Gamma."
    pair = lambda a, b: [(a, a.upper()), (b, b.upper())]
    rows = [(0, pair("Alpha", "Gamma")), (1, pair("Gamma", "Alpha")), (2, pair("Alpha", "Delta")), (3, [("Gamma", "GAMMA")])]
    df = (spark.createDataFrame(rows, f"question_id long, stations array<{rt.STATION}>").withColumn("content", F.lit(text))
          .withColumn("source_type", F.lit("train_route")))
    assert {(r.question_id, r.valid_route) for r in rt.validate_route(df).collect()} == {(0, True), (3, False)}


def test_token_match_is_stricter(spark):
    df = spark.createDataFrame([("Stops: NSC > HYB",)], "c string")
    s = lambda code: F.struct(F.lit("Nowhere").alias("name"), F.lit(code).alias("code"))
    row = df.select(rt.route_is_valid(F.col("c"), s("SC"), s("HYB")).alias("sub"), rt.route_is_valid(F.col("c"), s("SC"), s("HYB"), "token").alias("tok")).first()
    assert (row["sub"], row["tok"]) == (True, False)


def test_trim_keeps_ends_and_asked(spark):
    asked = F.array(F.struct(F.lit("Gamma").alias("name"), F.lit("GM").alias("code")))
    five = spark.createDataFrame([("T 1. Stops (5): A > B > Gamma > D > E.",), ("T 1. Stops (4): A > B > Gamma > D.",)], "c string")
    got = [r.c for r in five.select(rt.trim_route(F.col("c"), asked).alias("c")).collect()]
    assert got == ["T 1. Stops (5 total, key stops shown): A > Gamma > E.", "T 1. Stops (4): A > B > Gamma > D."]


def test_first_document_beyond_budget_stays(spark):
    rows = [(1, i, "c", 1.0, "x" * n) for i, n in enumerate((50, 5, 5), 1)] + [(2, 1, "c", 1.0, "y"), (2, 2, "c", 1.0, "z" * 30), (2, 3, "c", 1.0, "w")]
    df = spark.createDataFrame(rows, "question_id long, position int, collection string, score double, content string")
    assert {r.question_id: r.documents for r in rt.context_budget(df, budget=20).collect()} == {1: 1, 2: 1}


@pytest.mark.parametrize("short", [0, 12, 64])
def test_long_and_short_trains_take_the_asked_pairs(spark, short):
    rng = random.Random(9)
    stops = [(t, f"S{rng.randrange(30)}", i) for t, n in (("short", 5), ("long", 60), ("mid", 12)) for i in range(n)]
    pairs = [(f"S{rng.randrange(30)}", f"S{rng.randrange(30)}") for _ in range(40)] + [("S1", "S1")]
    got = sorted(tuple(r) for r in rt.between_stations(spark.createDataFrame(stops, "train_no string, station_code string, seq int"),
                                                       spark.createDataFrame(pairs, "origin string, target string"), short).collect())
    first = {}
    for t, s, i in stops:
        first.setdefault((t, s), i)
    want = {(a, b, t, first[t, a], first[t, b]) for a, b in pairs for t in ("short", "long", "mid")
            if (t, a) in first and (t, b) in first and first[t, a] < first[t, b]}
    assert got == sorted(want)


def test_a_hub_train_forms_no_pairs_of_its_own(spark):
    """A train of 3,000 stations and a few asked pairs: no step makes rows near its 4.5 million pairs."""
    stops = spark.createDataFrame([("hub", f"S{i}", i) for i in range(3000)] + [(f"t{k}", f"S{i}", i) for k in range(50) for i in range(4)], "train_no string, station_code string, seq int")
    pairs = spark.createDataFrame([(f"S{i}", f"S{2999 - i}") for i in range(3000)], "origin string, target string")
    found = rt.between_stations(stops, pairs)
    assert found.count() == 1500
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_slices_of_clustered_ids_are_even(spark):
    """Ids in two far clusters, a third of the rows one station's: no slice holds twice the mean."""
    rng = random.Random(4)
    rows = [("HUB" if i % 3 == 0 else f"S{i % 97}", "c", 0, (2_000_000_000_000 if i % 7 else 3_000_000_000_000) + i) for i in range(20_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "code string, collection string, term_no int, doc_id long")
    bounds = rt.slice_bounds(df)
    sizes = Counter(sum(b <= r[3] for b in bounds) for r in rows)
    assert len(sizes) == rt.SLICES and max(sizes.values()) < 2 * len(rows) / rt.SLICES
    got = {(r.code, r.doc_id): r.pos for r in rt.rank_postings(df).collect()}
    lists = {}
    for code, _, _, doc in sorted(rows, key=lambda r: r[3]):
        assert got[code, doc] == lists.setdefault(code, 0)
        lists[code] += 1
    assert rt.rank_postings(df.limit(0)).collect() == []


def test_mentions_of_short_and_very_long_texts(spark):
    """Places are right after other scripts, nulls and empty texts; 100,000 words take about 100 times as long as 1,000."""
    aliases = spark.createDataFrame([("guntur", "Guntur", "GNT", True), ("new delhi", "New Delhi", "NDLS", True), ("delhi", "Delhi", "DLI", True)], "alias string, name string, code string, is_name boolean")
    filler = "été 日本 word, "
    rows = [(1, "From New Delhi to Guntur"), (2, None), (3, ""), (4, filler * 3 + "guntur"), (5, "guntur")]
    df = spark.createDataFrame(rows, "question_id long, question string")
    got = {r.question_id: [(m.start, m.name) for m in r.mentions] for r in st.resolve_mentions(df, aliases).collect()}
    assert got == {1: [(5, "New Delhi"), (18, "Guntur")], 4: [(3 * len(filler), "Guntur")], 5: [(0, "Guntur")]}
    took = {}
    for words in (3_000, 100_000):
        text = filler * (words // 3) + "guntur and new delhi"
        long = spark.createDataFrame([(1, text)], "question_id long, question string")
        started = time.perf_counter()
        found = st.resolve_mentions(long, aliases).first().mentions
        took[words] = time.perf_counter() - started
        assert [(m.start, m.code) for m in found] == [(len(filler) * (words // 3), "GNT"), (len(filler) * (words // 3) + 11, "NDLS")]
    assert took[100_000] < 20


def test_no_cross_join_in_search_plans(spark):
    from railweave.plans.roles import Roles
    r = Roles(spark, "/root/testdata/sf0.001")
    docs, dim, aliases = r.search_docs(), r.station_dim(), r.aliases()
    for df in (rt.keyword_join(docs, dim), st.resolve_mentions(r.asked(), aliases), st.fuzzy_resolve(r.asked(), aliases),
               rt.exact_lookup(r.asked(), docs), vc.vector_topk(vc.hashed_embedding(r.asked(), "question"), r.embedded_docs())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_documents_are_cut_no_finer_than_the_tasks_need(spark):
    blocks = lambda n, q_blocks: spark.range(1).select(vc._document_blocks(F.lit(n), F.lit(q_blocks), F.lit(131072), 200)).first()[0]
    assert blocks(1_800_000, 1) == 400 and blocks(1_800_000, 11) == 37 and blocks(18_000_000, 1000) == 138 and blocks(0, 1) == 1


def test_only_wanted_collections_are_scored(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [0.8, 0.6]), ("b", 3, [1.0, 0.0]), ("c", 4, [0.6, 0.8])]
    documents = spark.createDataFrame(rows, "collection string, doc_id long, embedding array<double>")
    asked = spark.createDataFrame([("x", [1.0, 0.0], ["a"]), ("y", [0.6, 0.8], ["b", "c"]), ("z", [1.0, 0.0], None), ("w", [1.0, 0.0], [])],
                                  "question_id string, embedding array<double>, active array<string>")
    got = {(r["question_id"], r["doc_id"], r["rank"]) for r in vc.vector_topk(asked, documents, min_score=0.5, wanted="active").collect()}
    assert got == {("x", 1, 1), ("x", 2, 2), ("y", 3, 1), ("y", 4, 1), ("z", 1, 1), ("z", 2, 2), ("z", 3, 1), ("z", 4, 1)}


def test_wrong_trains_are_dropped_in_one_reading(spark):
    rows = [(1, "10", "train_routes", True), (1, "10", "trains", False), (1, "11", "trains", False), (1, None, "trains", False), (1, "11", "rules", False),
            (2, "11", "trains", False), (None, "10", "train_routes", True), (None, "11", "trains", False), (3, None, "train_routes", True), (3, None, "trains", False)]
    candidates = spark.createDataFrame(rows, "question_id int, train_no string, collection string, valid_route boolean")
    kept = rt.drop_wrong_trains(candidates)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if r not in [(1, "11", "trains", False), (1, None, "trains", False), (3, None, "trains", False)]}
