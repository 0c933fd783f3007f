"""Labelled questions of our own and the parts of the decision."""

import re

import pytest

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.operators import classify as cl
from railweave.operators import retrieve as rt

CASES = [
    ("Where is train 12345 right now", "LIVE", "LIVE_STATUS"),
    ("PNR 1234567890 please", "LIVE", "PNR_STATUS"),
    ("Has the 12345 been cancelled today?", "LIVE", "CANCELLATION_TODAY"),
    ("platform today for my train", "LIVE", "PLATFORM_TODAY"),
    ("What time does 12345 reach Guntur", "STATIC", "SCHEDULE_QUERY"),
    ("schedule of 12345", "STATIC", "SCHEDULE_QUERY"),
    ("trains between Guntur and Tenali", "STATIC", "BETWEEN_STATIONS"),
    ("details of Guntur station", "STATIC", "STATION_INFO"),
    ("refund rules", "STATIC", "CANCELLATION_RULES"),
    ("which coach is mine", "STATIC", "COACH_QUERY"),
    ("baggage allowance", "STATIC", "GENERAL_INFO"),
    ("write a poem about the sea", "OUT_OF_DOMAIN", "OUT_OF_DOMAIN"),
    ("Guntur express delayed", "HYBRID", "HYBRID"),
    ("late", "LIVE", "LIVE_STATUS"),
    ("halts and timings", "STATIC", "SCHEDULE_QUERY"),
    ("12345", "STATIC", "GENERAL_INFO"),
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([("guntur", "name"), ("tenali", "name"), ("gnt", "code")], "token string, kind string")


def test_labelled_questions(spark, vocabulary):
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(CASES)], "question_id int, question string")
    got = {r.question_id: (r.intent, r.intent_category) for r in cl.classify_questions(df, vocabulary).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(CASES)}


def test_synonyms_cascade(spark):
    df = spark.createDataFrame([("luggage in SL",)], "question string")
    assert rt.expand_synonyms(df).first().expanded == "luggage luggage baggage allowance allowance in Sleeper class SL"


def test_entities(spark):
    df = spark.createDataFrame([("train 1234 AC at GNT, 8101234567",), ("12345 and 1234",), ("year 2024",)], "q string")
    rows = df.select(tx.train_number("q").alias("t"), tx.booking_number("q").alias("p"), tx.station_code_token("q").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("1234", "8101234567", "GNT"), ("12345", None, None), (None, None, None)]


def test_collection_routing(spark):
    df = spark.createDataFrame([("coffee",), ("stops please",), ("hello",)], "q string")
    got = [r.c for r in df.select(rt.route_collections("q").alias("c")).collect()]
    assert got[0] == ["railway_rules", "references"] and got[1] == ["trains", "stations", "train_routes"] and len(got[2]) == 5


def test_patterns_tried_only_where_their_words_are_say_the_same(spark):
    texts = ["Where is train 12345 now?", "WHERE  is 12345", "how long halt at x 12345", "real-time position of 12345", "Which platform today", "is 12345 late",
             "trains from a to b", "coach S5", "halt 1234", "cancel policy", "info about new station", "spot train 12345", "ticket deposit receipt", "", None, "K 12345 eta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")
    patterns = [*fv.QUESTION_PATTERNS, (r"(?:halt|x)\b.{0,9}\bat\b", "A", 0.5), (r"a(b.{0,3}\b\d{4,5}\b.{0,3}c)?z|\bq\b", "B", 0.4), (r"\bcoach\b(?! t)", "C", 0.3)]
    got = {r["question_id"]: r["pattern_category"] for r in cl.match_patterns(rows, patterns=patterns).collect()}
    first = lambda t: next((c for p, c, _ in patterns if t is not None and re.search(p, t, re.IGNORECASE | re.ASCII)), None)
    assert got == {i: first(t) for i, t in enumerate(texts)}


def test_classes_are_stored_for_the_steps_that_read_them_again(spark):
    questions = spark.createDataFrame([(1, "Where is train 12345 now?"), (2, None)], "question_id int, question string")
    vocabulary = spark.createDataFrame([("abcd", "code")], "token string, kind string")
    found = cl.classify_questions(questions, vocabulary)
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString().upper()
    assert {r["question_id"]: r["intent_category"] for r in found.collect()} == {1: "LIVE_STATUS", 2: "OUT_OF_DOMAIN"}
