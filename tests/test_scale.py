"""What makes the larger tables work: tables in folders, blocks, neither side sent whole, texts left where they are."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from railweave.operators import retrieve as rt
from railweave.operators import stations as st
from railweave.operators import vectors as vc
from railweave.plans.roles import Roles


@pytest.mark.parametrize("name, table", [("st05_stream_documents", "documents"), ("st01_rate_limit_stream", "events")])
def test_streams_read_a_table_in_a_folder(spark, tmp_path, name, table):
    whole = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    of = lambda sf: sorted(map(tuple, entry.queries()[name](spark, sf).collect()))
    rows = of(str(tmp_path))
    assert rows and rows == of("/root/testdata/sf0.001")


@pytest.mark.parametrize("l2", [False, True])
def test_best_rows_equal_brute_force(l2):
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    a, b = rng.poisson(0.3, (700, 20)).astype(float), rng.poisson(0.3, (5000, 20)).astype(float)
    # vectors of unit length, and such whose products are beyond single precision
    for a, b in ((unit(a), unit(b)), (a * 2.0 ** 60, b * 2.0 ** 60)):
        b[7] = np.nan
        s = a @ b.T
        s = 1 - ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * s) / np.sqrt(2) if l2 else s
        r = np.where((s >= 0.2) & np.isfinite(s), np.round(s, 4), -np.inf)
        want = [(i, j, r[i, j]) for i in range(len(a)) for j in np.lexsort((np.arange(len(b)), -r[i]))[:3] if np.isfinite(r[i, j])]
        assert list(zip(*(x.tolist() for x in vc._best(a, b, 3, 0.2, l2)), strict=True)) == want


def test_most_products_are_passed_over_in_one_reading(monkeypatch):
    """The tiles' best guesses settle a floor, so few rows are scored exactly however many there are, and ties go by row."""
    rng = np.random.default_rng(5)
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.random((300, 16)) - 0.5, rng.random((20000, 16)) - 0.5))
    b[9000:9040] = b[8999]
    exact, scored = np.einsum, []
    monkeypatch.setattr(np, "einsum", lambda how, x, y: (scored.append(len(x)), exact(how, x, y))[1])
    rows, cols, scores = vc._best(a, b, 5, -1.0, False)
    r = np.round(a @ b.T, 4)
    assert [tuple(cols[rows == i]) for i in range(300)] == [tuple(np.lexsort((np.arange(20000), -x))[:5]) for x in r]
    assert sum(scored) < 300 * 40


@pytest.mark.parametrize("parts", [1, 12, 50])
def test_pairs_of_blocks_are_dealt_evenly(spark, parts):
    keys = vc.even_keys(3 * parts, parts)
    dealt = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).toArrow().column("p").to_pylist()
    assert len(set(keys)) == 3 * parts and dealt == [i % parts for i in range(3 * parts)]
    questions = spark.createDataFrame([("q", [1.0, 0.0])], "question_id string, embedding array<double>")
    documents = spark.createDataFrame([("c", i, [1.0, 0.0]) for i in range(3)], "collection string, doc_id long, embedding array<double>")
    plan = vc.vector_topk(questions, documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and not [line for line in plan.split("\n") if "Exchange hashpartitioning(pair" in line and "REPARTITION_BY_NUM" not in line]


@pytest.mark.parametrize("name", ["set02_union_ranked", "ret07_rrf_fuse"])
def test_lists_score_only_the_collections_that_are_asked(spark, monkeypatch, name):
    """What a question does not ask is dropped behind the search, so it need not be scored."""
    wanted, search = [], vc.vector_topk
    monkeypatch.setattr(vc, "vector_topk", lambda *a, **b: (wanted.append(b.get("wanted")), search(*a, **b))[1])
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert wanted == ["active"]


def test_small_inputs_that_grow_are_dealt_over_all_tasks(spark):
    words, names = spark.createDataFrame([("mangalor",)], "word string"), spark.createDataFrame([("mangalore",)], "alias string")
    assert st.similar_pairs(words, names, 0.8)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
    assert len(Roles(spark, "/root/testdata/sf0.01").asked().inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_no_side_of_the_similar_words_is_broadcast(spark):
    """Both sides are made longer by pieces, which size estimates do not see."""
    words, names = spark.createDataFrame([("mangalor",)], "word string"), spark.createDataFrame([("mangalore",), ("bangalore",)], "alias string")
    pairs = st.similar_pairs(words, names, 0.8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [la" in plan
    assert sorted(r.alias for r in pairs.collect()) == ["bangalore", "mangalore"]


def test_containment_keeps_rows_apart_and_sends_no_text(spark):
    """Ids repeat, words repeat in a text; a term without spaces needs no text beside the words."""
    rows = [(1, "SC sc Guntur", "c"), (1, "nsc", "c"), (1, "nsc", "c"), (2, "x", "c"), (3, "at Guntur Junction", None)]
    documents = spark.createDataFrame(rows, "doc_id long, content string, collection string")
    terms = spark.createDataFrame([("SC",), ("Guntur",), ("Guntur Junction",)], "term string")
    found = rt.contains_join(documents, terms)
    assert found.columns == ["doc_id", "collection", "term", "same_case"]
    want = [(d, t, t in x) for d, x, _ in rows for t in ("SC", "Guntur", "Guntur Junction") if t.lower() in x.lower()]
    assert sorted((r.doc_id, r.term, r.same_case) for r in found.collect()) == sorted(want)


def _shuffles(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]


def _roles(spark, tmp_path):
    """Trains of two and three stops, one without an order, an order without stops, and a null key."""
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "AFRICA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "KENYA", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(i, f"S{i}", 0, 10.0 * i) for i in (1, 2, 3)]),
        "customer": ("c_custkey long, c_name string, c_mktsegment string, c_nationkey int, c_acctbal double", [(1, "C1", "AUTO", 0, 5.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, 1, s, 9.0, datetime(2024, 1, 1), "1-URGENT") for k, s in ((1, "F"), (2, "P"), (3, "O"))]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_tax double, l_returnflag string, l_linestatus string",
                     [(k, 1, s, n, float(n), 1.0, 0.1, 0.02, "N", "O") for k, s, n in ((1, 2, 2), (1, 1, 1), (2, 3, 1), (2, 2, 2), (2, 1, 3), (9, 1, 1), (None, 1, 1))]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Roles(spark, str(tmp_path))


def test_trains_are_gathered_in_one_pass(spark, tmp_path):
    """Ends and stop lists of a train come from one shuffle of its stops, and the dimension tells its size."""
    r = _roles(spark, tmp_path)
    ends = {x.order_key: x for x in r.ends.collect()}
    assert set(ends) == {1, 2, 9, None}
    routes = {x.train_number: x for x in r.train_routes().collect()}
    assert {k: (x.source_station, x.dest_station, x.stop_codes) for k, x in routes.items()} == {
        "10001": ("AAAB", "nan", '["AAAB","AAAC"]'), "10002": (None, "AAAB", "[AAAD,AAAC,AAAB]")}
    assert [s["station_code"] for s in json.loads(routes["10002"].stops)] == ["AAAD", "AAAC", "AAAB"]
    assert ends[2].km == 6.0 and routes["10002"].total_distance_km == "6.0"
    # one shuffle for the windows, none to group the stops or to join the stations
    assert len(_shuffles(r.trains(codes=["station_code"]))) == 1
    assert sorted(x.train_number for x in r.decoded_routes().collect()) == ["10001", "10002"]


def test_trains_are_dealt_once_for_pairs(spark):
    """Train sizes are counted where the first places lie, not joined to them."""
    rows = [("t", "a", 1), ("t", "b", 2), ("t", "a", 3), ("u", "b", 1), ("u", "a", 2), *[("v", f"s{i}", i) for i in range(5)], ("v", "a", 9), (None, "a", 1), (None, "b", 2)]
    stops = spark.createDataFrame(rows, "train_no string, station_code string, seq int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("s1", "s4"), ("s4", "a")], "origin string, target string")
    for short in (64, 2):
        found = rt.between_stations(stops, pairs, short)
        assert sorted(tuple(x) for x in found.collect()) == [("a", "b", "t", 1, 2), ("b", "a", "u", 1, 2), ("s1", "s4", "v", 1, 4), ("s4", "a", "v", 4, 9)]
    plan = rt.between_stations(stops, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 4


def test_numbers_of_questions_are_taken_out_once(spark):
    asked = spark.createDataFrame([(1, "10001 and 10002"), (2, "10001"), (3, None)], "question_id long, question string")
    documents = spark.createDataFrame([(5, "trains", "10001"), (6, "train_routes", "10001"), (7, "trains", "10002")], "doc_id long, collection string, train_no string")
    found = rt.exact_lookup(asked, documents)
    assert sorted((x.question_id, x.rank, x.doc_id) for x in found.collect()) == [(1, 0, 5), (1, 1, 7), (1, 2, 6), (2, 0, 5), (2, 1, 6)]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
