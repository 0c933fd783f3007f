"""Nothing is cut, dropped or merged where the published limits are not asked for."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import runtime
from railweave.functions import text as tx
from railweave.operators import classify, documents, live, retrieve, sessions, stations
from railweave.sources import tables


def test_title_case_of_a_long_text(spark):
    word = "a" * 1_500_000
    got = spark.createDataFrame([(word,), ("o'neil sTREET 5x",)], "t string").select(tx.title_case("t").alias("t")).collect()
    assert [len(r.t) for r in got][0] == 1_500_000 and got[1].t == "O'Neil Street 5X"


def test_delays_of_many_digits(spark):
    df = spark.createDataFrame([("1234567890",), ("12 min",), ("9" * 30,), ("-5",), (None,), ("soon",)], "d string")
    assert [r[0] for r in df.select(tx.delay_minutes("d")).collect()] == [1234567890, 12, 0, 0, 0, 0]


def test_question_without_text_is_kept(spark):
    vocabulary = spark.createDataFrame([("ab", "code")], "token string, kind string")
    got = classify.classify_questions(spark.createDataFrame([(1, None), (2, ""), (3, "status of 12345")], "question_id long, question string"), vocabulary).collect()
    by = {r.question_id: r for r in got}
    assert set(by) == {1, 2, 3} and by[1].question is None and by[1].intent_category == by[2].intent_category and by[3].train_no == "12345"


def test_all_documents_of_a_number(spark):
    docs = spark.createDataFrame([("trains", "12345", k) for k in range(9)], "collection string, train_no string, doc_id long")
    asked = spark.createDataFrame([("q", "where is 12345 now")], "question_id string, question string")
    assert retrieve.exact_lookup(asked, docs).count() == 9 and retrieve.exact_lookup(asked, docs, per_number=5).count() == 5


def test_equal_beginnings_do_not_merge(spark):
    docs = spark.createDataFrame([("k", 1, "x" * 100 + "a"), ("k", 2, "x" * 100 + "b"), ("k", 3, "x" * 100 + "a")], "question_id string, rank int, content string")
    assert sorted(r["rank"] for r in retrieve.dedupe_prefix(docs).collect()) == [1, 2]
    assert [r["rank"] for r in retrieve.dedupe_prefix(docs, prefix_len=100).collect()] == [1]


def test_between_stations_of_long_and_short_trains(spark):
    stops = [("long", f"S{k}", k) for k in range(100)] + [("short", "S7", 1), ("short", "S3", 2), ("short", "S7", 3), ("x", "S3", 1)]
    asked = [("S3", "S7"), ("S7", "S3"), ("S99", "S0"), ("S0", "S99"), ("S3", "S3"), ("S3", "none")]
    first = {}
    for t, s, n in stops:
        first[t, s] = min(n, first.get((t, s), n))
    want = sorted((a, b, t, first[t, a], first[t, b]) for a, b in asked for t in {t for t, _, _ in stops} if first.get((t, a), 1e9) < first.get((t, b), -1))
    got = retrieve.between_stations(spark.createDataFrame(stops, "train_no string, station_code string, seq int"), spark.createDataFrame(asked * 2, "origin string, target string"))
    assert sorted(tuple(r) for r in got.select("origin", "target", "train_no", "from_seq", "to_seq").collect()) == want


def test_two_routes_of_one_train_stay_apart(spark):
    stop = '{{"station_code": "{0}", "is_stopping": true}}'
    a, b = (f"[{', '.join(stop.format(c) for c in codes)}]" for codes in (("A", "B"), ("B", "C", "A")))
    routes = spark.createDataFrame([(1, "100", a), (2, "100", b), (3, "200", a)], "row_id long, train_number string, stops string")
    stations = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("C", "Gamma")], "code string, name string")
    trains = spark.createDataFrame([(1, "100", "1,1,1,1,1,1,1")], "row_id long, train_number string, running_days_text string")
    got = documents.route_documents(routes, stations, trains).select("doc_id", "train_no", "total_stops").collect()
    assert sorted((r.train_no, r.total_stops) for r in got) == [("100", 2), ("100", 3), ("200", 2)] and len({r.doc_id for r in got}) == 3


def test_store_begins_with_an_empty_batch(spark, tmp_path):
    schema, root = "collection string, doc_id long, content string", str(tmp_path / "store")
    assert tables.append_missing(spark.createDataFrame([], schema), root).count() == 0
    tables.append_missing(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), root)
    tables.append_missing(spark.createDataFrame([("a", 1, "x"), ("a", 2, "z")], schema), root)
    tables.append_missing(spark.createDataFrame([], schema), root)
    assert sorted((r.collection, r.doc_id) for r in spark.read.parquet(root).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_observations_at_one_instant_give_one_answer(spark):
    obs = [("k", 10, f"v{n}") for n in range(6)]
    req = spark.createDataFrame([("k", 11, 1)], "key string, s int, request_id int").select("key", F.col("s").cast("timestamp").alias("ts"), "request_id")
    seen = set()
    for rows in (obs, obs[::-1], obs[3:] + obs[:3]):
        o = spark.createDataFrame(rows, "key string, s int, value string").select("key", F.col("s").cast("timestamp").alias("ts"), "value").repartition(3)
        seen.add(live.latest_within_ttl(req, o, 60).first()["value"])
    assert len(seen) == 1


def test_clients_without_key_are_one_client(spark):
    rows = spark.createDataFrame([(None, k, k) for k in range(6)] + [(7, 0, 9)], "client long, s int, request_id long").withColumn("ts", F.col("s").cast("timestamp"))
    got = sessions.rate_limit(rows, limit=2, seconds=60).collect()
    assert sorted(r.request_id for r in got if r.allowed) == [0, 1, 9]


def test_a_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "local-cluster[2,1,1024]"})()

    with pytest.raises(ValueError):
        runtime.scratch_root(Session())


def test_a_common_word_does_not_make_candidates(spark):
    """500 names that end alike: each leads to its own documents only."""
    names = [f"Station{k:03d} Junction" for k in range(500)] + ["Junction", "X Y"]
    docs = [(k, f"from {names[k % 500]} to the end, x y z") for k in range(2000)] + [(3000, "JUNCTION of all"), (3001, None), (3002, "")]
    documents_ = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, content string, collection string")
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    want = sorted((d, n) for d, t in docs if t for n in names if n.lower() in t.lower())
    got = retrieve.contains_join(documents_, terms).select("doc_id", "term", "same_case").collect()
    assert sorted((r.doc_id, r.term) for r in got) == want and sum(not r.same_case for r in got) == 2001
    assert retrieve.contains_candidates(documents_, terms).count() <= 1.1 * len(want)


def test_single_station_falls_back_to_the_closest_name(spark):
    names = ["Bangalore", "Mangalore", "Chennai Central", "Ahmedabad"]
    aliases = stations.alias_index(spark.createDataFrame([(f"C{k}", n, [], k) for k, n in enumerate(names)], "code string, name string, aka array<string>, ord int"))
    texts = ["train to bangalor please", "Chennai Central today", "from ahmedabd to mangalor", "nothing at all", "b" * 2000 + " word", "stations"]
    asked = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")

    def plain(text):
        low = text.lower()
        for n in sorted(names, key=len, reverse=True):
            if re.search(rf"\b{n.lower()}\b", low):
                return n
        for word in re.findall(r"\b[a-z]{4,}\b", low):
            if word not in fv.FUZZY_IGNORE and (close := difflib.get_close_matches(word, [n.lower() for n in names], n=1, cutoff=0.8)):
                return next(n for n in names if n.lower() == close[0])
        return None

    got = {r.question_id: r.name for r in stations.resolve_station_or_similar(asked, aliases).collect()}
    assert {k: got.get(k) for k in range(len(texts))} == {k: plain(t) for k, t in enumerate(texts)}


def test_question_without_documents_is_told(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "question_id string")
    results = spark.createDataFrame([("a", 1, "text", "c", 0.5)], "question_id string, position int, content string, collection string, score double")
    got = {r.question_id: (r.documents, r.context) for r in retrieve.context_or_none(asked, results).collect()}
    assert got["b"] == (0, fv.NO_DOCUMENTS) and got["a"][0] == 1
