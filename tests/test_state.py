"""State over time, with one key that holds most rows, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from railweave.functions.runtime import scratch_path
from railweave.functions.segmented import carry_last, dense_position, gap_segments, preceding_rows
from railweave.operators import live as lv
from railweave.operators import sessions as ss
from railweave.streaming import ingest
from railweave.streaming import state as sm

START = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng, out, t = random.Random(11), [], START
    for i in range(1500):
        t += timedelta(seconds=rng.choice([0, 1, 5, 20, 90, 4000]))
        out.append((i, "hot" if rng.random() < 0.7 else f"c{rng.randrange(5)}", t, rng.choice([None, "12727", "17225"]), rng.random() < 0.6))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "request_id long, client string, ts timestamp, train_no string, storable boolean")


def per_key(rows):
    keys = {}
    for r in rows:
        keys.setdefault(r[1], []).append(r)
    return keys.values()


def test_carry_last(df, rows):
    want = {}
    for group in per_key(rows):
        last = None
        for r in group:
            last = r[3] or last
            want[r[0]] = last
    got = carry_last(df.withColumn("h", F.date_trunc("hour", "ts")), "client", ["ts", "request_id"], "train_no", "h", "v")
    assert {r.request_id: r.v for r in got.collect()} == want


def test_positions_and_preceding_rows(df, rows):
    placed = dense_position(df.withColumn("h", F.date_trunc("hour", "ts")), "client", ["ts", "request_id"], "h", "pos")
    got = {r.request_id: (r.pos, [x.request_id for x in r.prev]) for r in preceding_rows(placed, "client", "pos", 5, ["request_id"], "prev", block=16).collect()}
    want = {}
    for group in per_key(rows):
        ids = [r[0] for r in group]
        want.update({i: (n, ids[max(0, n - 5):n]) for n, i in enumerate(ids)})
    assert got == want


def test_gap_segments(df, rows):
    timed = df.withColumn("us", F.unix_micros("ts")).withColumn("h", F.date_trunc("hour", "ts"))
    got = {r.request_id: r.seg for r in gap_segments(timed, "client", "us", "request_id", 60_000_000, "h", "seg").collect()}
    us = lambda t: int((t - START).total_seconds()) * 1_000_000
    base = None
    for group in per_key(rows):
        start = prev = None
        for r in group:
            if prev is None or us(r[2]) - prev >= 60_000_000:
                start = us(r[2])
            prev = us(r[2])
            base = got[r[0]] - start if base is None else base
            assert got[r[0]] - start == base


def limited(rows, limit, seconds):
    want = {}
    for group in per_key(rows):
        accepted = []
        for r in group:
            accepted = [t for t in accepted if (r[2] - t).total_seconds() < seconds]
            want[r[0]] = len(accepted) < limit
            if want[r[0]]:
                accepted.append(r[2])
    return want


def test_rate_limit(df, rows):
    got = {r.request_id: r.allowed for r in ss.rate_limit(df, limit=3).collect()}
    assert got == limited(rows, 3, 60)


def test_sixteen_requests_in_a_minute(spark):
    times = [START + timedelta(seconds=3 * i) for i in range(16)] + [START + timedelta(seconds=60)]
    data = spark.createDataFrame([(i, "x", t) for i, t in enumerate(times)], "request_id long, client string, ts timestamp")
    allowed = [r.allowed for r in ss.rate_limit(data).orderBy("request_id").collect()]
    assert allowed == [True] * 15 + [False, True]


def cached(rows, ttl):
    want = {}
    for group in per_key(rows):
        entry = None
        for r in group:
            hit = entry is not None and (r[2] - entry[1]).total_seconds() < ttl
            want[r[0]] = (hit, entry[0] if hit else None)
            if not hit:
                entry = (r[0], r[2]) if r[4] else None
    return want


def test_ttl_cache(df, rows):
    got = {r.request_id: (r.from_cache, r.served_id) for r in ss.ttl_cache(df, "client", ttl_seconds=300).collect()}
    assert got == cached(rows, 300)


def test_entry_expires_at_its_ttl(spark):
    data = spark.createDataFrame([(i, "q", START + timedelta(seconds=s), True) for i, s in enumerate((0, 599, 600))], "request_id long, k string, ts timestamp, storable boolean")
    assert [(r.from_cache, r.age_seconds) for r in ss.ttl_cache(data, "k").orderBy("request_id").collect()] == [(False, None), (True, 599), (False, None)]


def test_latest_observation(df, rows, spark):
    obs = df.where("storable").select("client", "ts", F.col("request_id").alias("value"))
    req = df.where("NOT storable").select("request_id", "client", "ts")
    got = {r.request_id: r.value for r in lv.latest_within_ttl(req, obs, 100, key="client").collect()}
    want = {}
    for r in rows:
        if not r[4]:
            seen = [o for o in rows if o[4] and o[1] == r[1] and o[2] <= r[2]]
            last = max((o[2] for o in seen), default=None)
            fresh = last is not None and (r[2] - last).total_seconds() < 100
            want[r[0]] = {o[0] for o in seen if o[2] == last} if fresh else {None}
    assert got.keys() == want.keys() and all(got[k] in want[k] for k in got)


def drain(spark, df, fn, name):
    src = scratch_path(spark, f"{name}-in")
    df.write.parquet(src)
    stream = fn(ingest.read_stream(spark, src, df.schema))
    out = scratch_path(spark, name)
    ingest.run_to_files(stream, out, scratch_path(spark, f"{name}-ck"))
    return spark.read.schema(stream.schema).parquet(out)


def test_streams_agree_with_batch(spark, df, rows):
    lim = drain(spark, df, lambda s: sm.stream_rate_limit(s, limit=3), "limit")
    assert {r.request_id: r.allowed for r in lim.collect()} == limited(rows, 3, 60)
    cache = drain(spark, df, lambda s: sm.stream_ttl_cache(s, "client", ttl_seconds=300), "cache")
    assert {r.request_id: (r.from_cache, r.served_id) for r in cache.collect()} == cached(rows, 300)


def test_history_of_a_session(spark):
    turns = spark.createDataFrame([("s", i, f"q{i}", "a" * (301 if i == 0 else 3)) for i in range(8)], "session_id string, turn_id int, question string, answer string")
    got = {r.turn_id: r.history for r in ss.recent_turns(turns, ts="turn_id", chunk="floor(turn_id / 3)").collect()}
    assert got[0] == "" and got[1].endswith("a" * 300 + "...\n")
    assert [f"q{i}" in got[7] for i in range(8)] == [False, False, True, True, True, True, True, False]
