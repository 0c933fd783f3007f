"""Streams over micro-batches with late, repeated and out-of-order rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from railweave.functions.runtime import scratch_path
from railweave.operators import live as lv
from railweave.operators import sessions as ss
from railweave.streaming import live as sl
from railweave.streaming import sessions as st

BASE = dt.datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    st.state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


class Feed:
    """Micro-batches of one or more sources, run one after the other with one checkpoint."""

    def __init__(self, spark, make, **schemas):
        self.spark, self.root, self.schemas = spark, scratch_path(spark, "feed"), schemas
        for name in schemas:
            os.makedirs(f"{self.root}/{name}")
        self.make, self.n = make, 0

    def send(self, **batches):
        for name, rows in batches.items():
            self.n += 1
            self.spark.createDataFrame(rows, self.schemas[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        sources = [self.spark.readStream.schema(s).parquet(f"{self.root}/{name}") for name, s in self.schemas.items()]
        query = self.make(*sources).writeStream.format("parquet").option("path", f"{self.root}-out").option("checkpointLocation", f"{self.root}-at").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress = [p for p in query.recentProgress]

    def rows(self):
        return self.spark.read.parquet(f"{self.root}-out")

    def state_rows(self):
        return sum(o["numRowsTotal"] for o in self.progress[-1]["stateOperators"])


TURNS = "session_id string, turn_id long, ts timestamp, question string, answer string, train_no string"


def test_sessions_in_event_order(spark):
    """Three micro-batches, rows out of order across them: as the batch forms give them."""
    batches = [[("a", 1, at(0), "q1", "x", "11"), ("a", 3, at(20), "q3", "y" * 301, None), ("b", 4, at(21), "q4", "z", None)],
               [("a", 2, at(10), "q2", None, "22"), ("b", 5, at(5), "q5", "w", "55"), (None, 9, at(22), "q9", "v", "99"), ("a", 6, at(25), "q6", "u", None)],
               [("a", 7, at(26), "q7", "t", "77"), ("a", 8, at(26), "q8", "s", None), (None, 10, at(40), "q10", "r", None)]]
    everything = spark.createDataFrame(sum(batches, []), TURNS)
    for make, batch, out in ((st.stream_recent_turns, ss.recent_turns, "history"), (st.stream_session_train, ss.carry_train, "session_train")):
        feed = Feed(spark, lambda s, make=make: make(s, tie="turn_id", ttl="4 hours"), turns=TURNS)
        for rows in batches:
            feed.send(turns=rows)
        feed.send(turns=[("end", 99, at(2000), "end", "end", None)])
        got = {r.turn_id: r[out] for r in feed.rows().collect()}
        want = {r.turn_id: r[out] for r in batch(everything, tie="turn_id").collect()}
        assert {k: v for k, v in got.items() if k != 99} == want and feed.rows().count() == len(want)


def test_sessions_expire(spark):
    """A session that rests for the TTL begins anew, its state is gone, and rows behind the watermark are dropped."""
    feed = Feed(spark, lambda s: st.stream_session_train(s, tie="turn_id", ttl="1 hour", late="10 minutes"), turns=TURNS)
    feed.send(turns=[(f"s{k}", k, at(0), "q", "x", "11") for k in range(50)] + [("live", 100, at(90), "q", "x", "1")])
    feed.send(turns=[("live", 101, at(130), "q", "x", None), ("s0", 102, at(3), "q", "x", "late")])
    full = feed.state_rows()
    feed.send(turns=[("live", 103, at(170), "q", "x", None), ("s1", 104, at(171), "q", "x", None)])
    feed.send(turns=[("end", 999, at(175), "q", "x", None)])
    feed.send(turns=[("end", 1000, at(400), "q", "x", None)])
    got = {r.turn_id: r.session_train for r in feed.rows().collect()}
    assert {got[k] for k in range(50)} == {"11"} and got[101] == got[103] == "1" and got[104] is None and 102 not in got
    assert feed.state_rows() < 20 <= full or feed.state_rows() < 20


OBS, REQ = "key string, ts timestamp, value string", "key string, ts timestamp, request_id long"


def test_newest_observation_over_micro_batches(spark):
    """Observations that come after the request, repeats, and one behind the watermark."""
    observations = [[("k", at(0), "a"), ("k", at(0), "a"), ("m", at(1), "m1")], [("k", at(6), "c"), ("k", at(4), "b"), ("k", at(0), "a")], [("k", at(30), "d")]]
    requests = [[("k", at(3), 1), ("k", at(5), 2), ("none", at(5), 3)], [("m", at(2), 4), ("k", at(9), 5)], [("m", at(25), 6)]]
    feed = Feed(spark, lambda o, r: sl.stream_latest_within_ttl(r, o, 600), o=OBS, r=REQ)
    for o, r in zip(observations, requests, strict=True):
        feed.send(o=o, r=r)
    feed.send(o=[("k", at(1), "behind"), ("end", at(500), "e")], r=[("end", at(500), 99)])
    feed.send(o=[("end", at(900), "e")], r=[("end", at(900), 100)])
    got = {r.request_id: (r.value, r.from_cache, r.age_seconds) for r in feed.rows().collect() if r.request_id < 90}
    every = spark.createDataFrame(sum(observations, []), OBS), spark.createDataFrame(sum(requests, []), REQ)
    want = {r.request_id: (r.value, r.from_cache, r.age_seconds) for r in lv.latest_within_ttl(every[1], every[0], 600).collect()}
    assert got == want and got[2] == ("b", True, 60) and got[6] == (None, False, None)


def test_first_success_by_window(spark):
    schema = "key string, ts timestamp, priority int, success boolean, value string"
    feed = Feed(spark, lambda s: sl.stream_first_success(s, ["key"]), tries=schema)
    feed.send(tries=[("k", at(0), 2, True, "second"), ("k", at(1), 1, False, "bad"), ("m", at(1), 1, False, "bad")])
    feed.send(tries=[("k", at(2), 1, True, "first"), ("m", at(6), 3, True, "late")])
    feed.send(tries=[("k", at(100), 1, True, "x")])
    got = {(r.key, r.window_start): (r.value, r.success, r.error) for r in feed.rows().collect()}
    assert got == {("k", at(0)): ("first", True, None), ("m", at(0)): (None, False, "all sources failed"), ("m", at(5)): ("late", True, None)}


def test_repeats_are_dropped_within_the_watermark(spark):
    feed = Feed(spark, lambda o: sl.distinct_observations(o, ["key", "value"]), o=OBS)
    feed.send(o=[("k", at(0), "a"), ("k", at(1), "a"), ("k", at(1), "b")])
    feed.send(o=[("k", at(2), "a"), ("k", at(3), "c")])
    assert sorted(r.value for r in feed.rows().collect()) == ["a", "b", "c"]
