"""Queries over state in time, the question log, answer checks and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.functions.runtime import scratch_path
from railweave.operators import classify as cl
from railweave.operators import quality as ql
from railweave.operators import sessions as ss
from railweave.plans import question_checks as qc
from railweave.plans.questions import classified
from railweave.plans.registry import query
from railweave.sources import tables as src
from railweave.streaming import ingest
from railweave.streaming import sessions as st
from railweave.streaming import state as sm

# ------------------------------------------------------------------ sessions, limits


@query("ses01_carry_train", """
    SELECT event_id, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_train
    FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN props END AS n FROM {events})""")
def _(r):
    e = r.events.withColumn("train_no", F.when(F.col("event_type") == "purchase", F.col("props")))
    return ss.carry_train(e, "user_id", "ts", "event_id").select("event_id", "session_train")


@query("ses02_recent_turns", """
    SELECT conv_id, turn, coalesce(chr(10) || '=== CONVERSATION HISTORY (for context) ===' || chr(10) || nullif(array_to_string(list('User: ' || question || chr(10) || 'Assistant: '
             || CASE WHEN length(answer) > 300 THEN substr(answer, 1, 300) || '...' ELSE answer END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)), '') || chr(10), '') AS history
    FROM {turn_pairs}""")
def _(r):
    return (ss.recent_turns(r.turn_pairs, "conv_id", "turn", "turn", chunk="floor(turn / 4)").select("conv_id", "turn", "history"))


_LIMIT = dict(
    numbered="SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS k FROM {requests}",
    greedy_limit="""
    SELECT client, k, request_id, true AS allowed, [us] AS l FROM {numbered} WHERE k = 1
    UNION ALL
    SELECT n.client, n.k, n.request_id, len(list_filter(g.l, lambda x: n.us - x < 21600000000)) < 2,
           CASE WHEN len(list_filter(g.l, lambda x: n.us - x < 21600000000)) < 2 THEN list_append(list_filter(g.l, lambda x: n.us - x < 21600000000), n.us)
                ELSE list_filter(g.l, lambda x: n.us - x < 21600000000) END
    FROM greedy_limit g JOIN {numbered} n ON n.client = g.client AND n.k = g.k + 1""")


@query("st01_rate_limit", "SELECT request_id, allowed FROM {greedy_limit}", recursive=True, **_LIMIT)
def _(r):
    """Two requests per six hours and client, which the events reach."""
    return ss.rate_limit(r.requests, limit=2, seconds=21600).select("request_id", "allowed")


def _cache_check(key: str, storable: str, ttl: int) -> dict:
    return dict(
        numbered=f"SELECT *, {key} AS key, {storable} AS ok, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, request_id) AS k FROM {{requests}}",
        greedy_cache=f"""
        SELECT key, k, request_id, false AS from_cache, NULL::bigint AS served_id, NULL::bigint AS age_seconds, CASE WHEN ok THEN us END AS stored, CASE WHEN ok THEN request_id END AS sid
        FROM {{numbered}} WHERE k = 1
        UNION ALL
        SELECT n.key, n.k, n.request_id, coalesce(n.us - g.stored < {ttl}, false), CASE WHEN n.us - g.stored < {ttl} THEN g.sid END, CASE WHEN n.us - g.stored < {ttl} THEN (n.us - g.stored) // 1000000 END,
               CASE WHEN n.us - g.stored < {ttl} THEN g.stored WHEN n.ok THEN n.us END, CASE WHEN n.us - g.stored < {ttl} THEN g.sid WHEN n.ok THEN n.request_id END
        FROM greedy_cache g JOIN {{numbered}} n ON n.key = g.key AND n.k = g.k + 1""".replace("{{", "{").replace("}}", "}"))


@query("st02_response_cache", "SELECT request_id, from_cache, served_id, age_seconds FROM {greedy_cache}", recursive=True,
       **_cache_check("lower(trim(question))", "intent = 'STATIC' AND value < 50", 21600000000))
def _(r):
    req = r.requests.withColumn("validation_warnings", F.when(F.col("value") < 50, F.array().cast("array<string>")).otherwise(F.array(F.lit("w"))))
    return ss.response_cache(req, ttl_seconds=21600).select("request_id", "from_cache", "served_id", "age_seconds")


@query("st03_status_cache", "SELECT request_id, from_cache, served_id, age_seconds FROM {greedy_cache}", recursive=True,
       **_cache_check("client", "event_type <> 'error'", 10800000000))
def _(r):
    req = r.requests.withColumn("storable", F.col("event_type") != "error")
    return ss.ttl_cache(req, "client", ttl_seconds=10800).select("request_id", "from_cache", "served_id", "age_seconds")


# ------------------------------------------------------------------------ streams


def _event_stream(r):
    return ingest.stream_table(r.spark, f"{r.sf}/events.parquet", r.events.schema)


def _as_requests(e):
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_type").alias("event_type"), (F.col("event_type") != "error").alias("storable"))


def _drained(r, stream, name):
    out, ckpt = scratch_path(r.spark, name), scratch_path(r.spark, f"{name}-checkpoint")
    ingest.run_to_files(stream, out, ckpt)
    return r.spark.read.schema(stream.schema).parquet(out)


@query("st01_rate_limit_stream", "SELECT request_id, allowed FROM {greedy_limit}", recursive=True, **_LIMIT)
def _(r):
    limited = sm.stream_rate_limit(_as_requests(_event_stream(r)), limit=2, seconds=21600)
    return _drained(r, limited, "limits").select("request_id", "allowed")


@query("st03_status_cache_stream", "SELECT request_id, from_cache, served_id, age_seconds FROM {greedy_cache}", recursive=True,
       **_cache_check("client", "event_type <> 'error'", 10800000000))
def _(r):
    cached = sm.stream_ttl_cache(_as_requests(_event_stream(r)), "client", ttl_seconds=10800)
    return _drained(r, cached, "status-cache").select("request_id", "from_cache", "served_id", "age_seconds")


@query("ses01_carry_train_stream", """
    SELECT event_id, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_train
    FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN props END AS n FROM {events})""")
def _(r):
    e = _event_stream(r).withColumn("train_no", F.when(F.col("event_type") == "purchase", F.col("props"))).withColumn("ts", F.col("ts").cast("timestamp"))
    carried = sm.stream_carry_train(e, "user_id", "ts", "event_id")
    return _drained(r, carried, "carry").select("event_id", "session_train")


_RUNS = dict(
    gaps="SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {events}",
    runs="SELECT *, sum(CASE WHEN gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM {gaps}",
    passed="SELECT max(epoch_us(ts)) // 1000 - 1800000 AS ms FROM {events}")


def _session_stream(r, make, name):
    """Sessions of the event stream that rest for six hours begin anew; rows that the watermark has not passed wait."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = r.spark.conf.get(store)
    st.state_store(r.spark)
    try:
        return _drained(r, make(_event_stream(r).withColumn("train_no", F.when(F.col("event_type") == "purchase", F.col("props"))), "user_id", "ts", "event_id"), name)
    finally:
        r.spark.conf.set(store, before)


@query("ses01_session_train_stream", """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_train
    FROM {runs} WHERE epoch_us(ts) // 1000 < (SELECT ms FROM {passed})""", **_RUNS)
def _(r):
    return _session_stream(r, st.stream_session_train, "session-train").select("event_id", "session_train")


@query("ses02_recent_turns_stream", """
    SELECT event_id, coalesce(chr(10) || '=== CONVERSATION HISTORY (for context) ===' || chr(10) || nullif(array_to_string(list('User: ' || event_type || chr(10) || 'Assistant: '
             || CASE WHEN length(props) > 300 THEN substr(props, 1, 300) || '...' ELSE props END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)), '') || chr(10), '') AS history
    FROM {runs} WHERE epoch_us(ts) // 1000 < (SELECT ms FROM {passed})""", **_RUNS)
def _(r):
    turns = lambda e, *names: st.stream_recent_turns(e, *names, "event_type", "props")
    return _session_stream(r, turns, "recent-turns").select("event_id", "history")


@query("st04_stream_query_stats", """
    SELECT date_trunc('day', ts) AS window_start, intent, count(*) AS queries, round(avg(response_time_ms), 1) AS avg_response_time_ms, count(error) AS errors
    FROM {query_log} WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {query_log}) GROUP BY ALL""")
def _(r):
    """Daily windows over the log; windows the watermark has not passed stay open."""
    log = _event_stream(r).select("ts", F.col("event_type").alias("intent"), F.col("value").alias("response_time_ms"),
                                  F.when(F.col("event_type") == "error", "failed").alias("error"))
    return _drained(r, sm.stream_query_stats(log), "stats")


@query("st05_stream_documents", "SELECT lang AS collection, count(*) AS documents, cast(sum(length(text)) as bigint) AS chars FROM {documents} GROUP BY lang")
def _(r):
    """The stream is run twice from new checkpoints; the second run adds nothing."""
    root = scratch_path(r.spark, "stream-docs")
    for attempt in ("first", "again"):
        docs = ingest.stream_table(r.spark, f"{r.sf}/documents.parquet", r.documents.schema).select(
            F.col("lang").alias("collection"), "doc_id", F.col("text").alias("content"))
        ingest.stream_documents(docs, root, scratch_path(r.spark, f"stream-docs-{attempt}")).awaitTermination()
    return (src.read_collection(r.spark, root).groupBy("collection")
            .agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("content")).alias("chars")))


# -------------------------------------------------------------------- log analytics


def _log(r):
    flagged = F.when(F.col("flagged"), F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    return r.query_log.withColumn("validation_warnings", flagged)


@query("agg01_query_stats", """
    SELECT count(*) AS total_queries, round(sum(response_time_ms) / count(*), 1) AS avg_response_time_ms, count(error) AS error_count, round(count(error) / count(*) * 100, 1) AS error_rate_pct,
           count(*) FILTER (WHERE live_api_used) AS live_api_used, round(count(*) FILTER (WHERE live_api_success) / count(*) FILTER (WHERE live_api_used) * 100, 1) AS live_api_success_rate_pct,
           count(*) FILTER (WHERE flagged) AS hallucination_flags FROM {query_log}""")
def _(r):
    return ql.query_stats(_log(r))


@query("agg02_intent_distribution", "SELECT coalesce(CASE WHEN value > 5 THEN event_type END, 'UNKNOWN') AS intent, count(*) AS queries FROM {events} GROUP BY 1")
def _(r):
    return ql.intent_distribution(r.events.select(F.when(F.col("value") > 5, F.col("event_type")).alias("intent")))


@query("agg03_top_questions", """
    SELECT substr(trim(lower(question)), 1, 100) AS question, count(*) AS asked, min(ts) AS first_ts FROM {query_log} GROUP BY 1 ORDER BY asked DESC, first_ts, question LIMIT 10""")
def _(r):
    return ql.top_questions(r.query_log, chars=fv.TOP_QUESTION_CHARS)


@query("agg03_top_whole_questions", """
    SELECT trim(lower(question)) AS question, count(*) AS asked, min(ts) AS first_ts FROM {query_log} GROUP BY 1 ORDER BY asked DESC, first_ts, question LIMIT 10""")
def _(r):
    return ql.top_questions(r.query_log)


@query("agg04_collection_counts", "SELECT source AS collection, count(*) AS documents FROM {documents} GROUP BY ROLLUP (source)")
def _(r):
    return ql.collection_counts(r.documents.select(F.col("source").alias("collection")))


_LINES = dict(profile="""
    SELECT doc_id, lang, source, len(l) AS total, len(list_filter(l, lambda x: x = '')) AS blank, len(list_filter(l, lambda x: regexp_matches(x, '^(#|//|--|<!--)'))) AS comments,
           len(l) - len(list_filter(l, lambda x: x = '')) - len(list_filter(l, lambda x: regexp_matches(x, '^(#|//|--|<!--)'))) AS sloc
    FROM (SELECT doc_id, lang, source, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l
          FROM (SELECT doc_id, lang, source, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM {documents}))""")


@query("agg10_line_profile", """
    SELECT lang, source, count(*) AS files, cast(sum(sloc) as bigint) AS sloc, cast(sum(comments) as bigint) AS comments, cast(sum(blank) as bigint) AS blank, cast(sum(total) as bigint) AS total
    FROM {profile} WHERE total > 0 GROUP BY GROUPING SETS ((lang), (source), ())""", **_LINES)
def _(r):
    return ql.line_breakdown(ql.line_profile(r.documents), "lang", "source")


@query("agg11_largest_items", "SELECT doc_id, total, sloc FROM {profile} WHERE total > 0 ORDER BY total DESC, doc_id LIMIT 10", **_LINES)
def _(r):
    return ql.largest_items(ql.line_profile(r.documents), "doc_id").select("doc_id", "total", "sloc")


# ------------------------------------------------------------------ answers, evaluation

_NUMBERS = "list_filter(list_distinct(list_transform(regexp_extract_all({c}, '\\b(0?\\d{{4,5}})\\b', 1), lambda t: cast(cast(t as int) as varchar))), lambda t: t <> '0')"
_ANSWERS = dict(answers="""
    SELECT o_orderkey, cast(10000 + o_orderkey as varchar) AS n, CASE WHEN o_orderstatus = 'F' THEN cast(10000 + o_orderkey as varchar) END AS train_no,
           'Take ' || CASE WHEN o_orderstatus = 'O' THEN '0' ELSE '' END || cast(1000 + length(c_name) as varchar) || ' or ' || cast(10000 + o_orderkey as varchar) || ', class ' || o_orderpriority || ' at 00000' AS answer,
           CASE WHEN c_acctbal > 5000 THEN 'Train ' || cast(10000 + o_orderkey as varchar) || ' by ' || c_name ELSE 'Train 1018 by ' || c_mktsegment END AS context
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey""")


def _answers(r):
    n = (F.col("o_orderkey") + 10000).cast("string")
    return r.orders.join(r.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", n).alias("train_no"),
        F.concat(F.lit("Take "), F.when(F.col("o_orderstatus") == "O", "0").otherwise(""), (F.length("c_name") + 1000).cast("string"), F.lit(" or "), n, F.lit(", class "), "o_orderpriority", F.lit(" at 00000")).alias("answer"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("Train "), n, F.lit(" by "), "c_name")).otherwise(F.concat(F.lit("Train 1018 by "), "c_mktsegment")).alias("context"))


@query("set03_unsupported_entities", f"""
    SELECT o_orderkey, array_to_string(list_sort(list_filter({_NUMBERS.format(c='answer')}, lambda t: NOT list_contains({_NUMBERS.format(c='context')}, t))), ',') AS missing FROM {{answers}}""", **_ANSWERS)
def _(r):
    return _answers(r).select("o_orderkey", F.array_join(F.array_sort(ql.unsupported_entities("answer", "context")), ",").alias("missing"))


@query("ana01_validate_answers", f"""
    SELECT o_orderkey, array_to_string(list_sort(list_transform(list_filter({_NUMBERS.format(c='answer')}, lambda t: NOT list_contains({_NUMBERS.format(c='context')}, t) AND (train_no IS NULL OR t <> train_no)),
           lambda t: '⚠️ Answer mentions train ' || t || ' which was not found in retrieved context — possible hallucination.')), ' ; ') AS warnings FROM {{answers}}""", **_ANSWERS)
def _(r):
    return ql.validate_answers(_answers(r)).select("o_orderkey", F.array_join(F.array_sort("warnings"), " ; ").alias("warnings"))


_EXPECTED = """CASE WHEN o_orderstatus || substr(o_orderpriority, 1, 1) IN ('F1', 'F5', 'O1') THEN 'LIVE' WHEN o_orderstatus || substr(o_orderpriority, 1, 1) = 'P1' THEN 'OUT_OF_DOMAIN' ELSE 'STATIC' END"""


def _labelled(r):
    t = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))
    expected = F.when(t.isin("F1", "F5", "O1"), "LIVE").when(t == "P1", "OUT_OF_DOMAIN").otherwise("STATIC")
    labels = r.orders.select(F.col("o_orderkey").alias("question_id"), expected.alias("expected"))
    return classified(r).join(labels, "question_id").withColumnRenamed("intent", "actual")


@query("eval01_intent_accuracy", f"""
    SELECT round(avg(CASE WHEN expected = intent THEN 1.0 ELSE 0.0 END), 4) AS accuracy, cast(sum(CASE WHEN expected = intent THEN 1 ELSE 0 END) as bigint) AS correct, count(*) AS total
    FROM (SELECT {_EXPECTED} AS expected, intent FROM {{orders}} JOIN {{questions}} q ON q.question_id = o_orderkey JOIN {{classified}} c ON c.question = q.question)""", **qc.CLASSIFY)
def _(r):
    return ql.intent_accuracy(_labelled(r))


@query("eval01_intent_failures", f"""
    SELECT question_id, expected, intent AS actual FROM (SELECT question_id, {_EXPECTED} AS expected, intent FROM {{orders}} JOIN {{questions}} q ON q.question_id = o_orderkey
    JOIN {{classified}} c ON c.question = q.question) WHERE expected <> intent""", **qc.CLASSIFY)
def _(r):
    return ql.intent_failures(_labelled(r)).select("question_id", "expected", "actual")


@query("eval03_hallucination_rate", """
    SELECT round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 4) AS hallucination_rate, count(*) FILTER (WHERE bad) AS hallucinations_found, count(*) AS queries_tested
    FROM (SELECT len(list_filter(regexp_extract_all(answer, '\\b(\\d{5})\\b', 1), lambda t: NOT list_contains(regexp_extract_all(context, '\\b(\\d{5})\\b', 1), t))) > 0 AS bad FROM {answers})""", **_ANSWERS)
def _(r):
    return ql.hallucination_rate(_answers(r))
