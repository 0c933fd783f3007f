"""State over time, batch form: session carry-over, history, rate limits, caches.

All of these follow one key through time. Keys are split by time (see
``functions.segmented``), so one busy client or question is not one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, LongType, StructField, StructType

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.functions.segmented import carry_last, dense_position, gap_segments, hour_chunk, preceding_rows


def carry_train(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "question_id",
                value: str = "train_no", out: str = "session_train") -> DataFrame:
    """The latest train number of the session up to each question."""
    return carry_last(df.withColumn("_chunk", hour_chunk(ts)), session, [ts, tie], value, "_chunk", out).drop("_chunk")


def recent_turns(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "turn_id", question: str = "question",
                 answer: str = "answer", turns: int = fv.HISTORY_TURNS, chunk: str | None = None, out: str = "history") -> DataFrame:
    """The last five question-answer pairs before each turn as text, long answers cut.

    Turns without a session are one session.
    """
    # a struct is no null, so its rows meet in joins
    chunked = df.withColumn("_chunk", hour_chunk(ts) if chunk is None else F.expr(chunk)).withColumn("_session", F.struct(session))
    placed = dense_position(chunked, "_session", [ts, tie], "_chunk", "_pos").drop("_chunk")
    pair = F.concat(F.lit("User: "), F.col(question), F.lit("\nAssistant: "), tx.preview(answer)).alias("t")
    slim = placed.select(*df.columns, "_session", "_pos", pair)
    got = preceding_rows(slim, "_session", "_pos", turns, ["t"], "_h")
    lines = F.array_join(F.transform("_h", lambda x: x["t"]), "\n")
    return got.withColumn(out, F.when(F.size("_h") > 0, F.concat(F.lit(fv.HISTORY_HEADER), lines, F.lit("\n"))).otherwise("")) \
              .drop("_h", "_pos", "t", "_session")


def _sequential(df: DataFrame, keys: list[str], order: list[str], fresh_state: Callable, step: Callable, out_fields: dict[str, DataType],
                read: list[str]) -> DataFrame:
    """Runs ``step(state, *values) -> tuple`` over the rows of each key in order.

    Rows are hash-partitioned by key and sorted, then pass through as Arrow
    batches; only the small state of the current key is held, never its rows.
    """
    schema = StructType(df.schema.fields + [StructField(name, kind) for name, kind in out_fields.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            results = []
            key_rows = zip(*[pdf[k] for k in keys])
            for key, values in zip(key_rows, zip(*[pdf[c] for c in read])):
                key = tuple(None if pd.isna(k) else k for k in key)  # numeric NULL keys arrive as NaN
                if key != current:
                    current, state = key, fresh_state()
                results.append(step(state, *values))
            columns = list(zip(*results)) if results else [[] for _ in out_fields]
            yield pdf.assign(**{n: pd.Series(list(c), index=pdf.index, dtype=object) for n, c in zip(out_fields, columns)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def limiter_step(limit: int, window_micros: int):
    """One request against the timestamps accepted within the window."""
    def step(accepted: deque, micros: int):
        while accepted and micros - accepted[0] >= window_micros:
            accepted.popleft()
        if len(accepted) >= limit:
            return (False,)
        accepted.append(micros)
        return (True,)

    return step


def cache_step(ttl_micros: int):
    """One lookup; a miss stores the row if it may be stored."""
    def step(entry: dict, micros: int, row_id, storable: bool):
        if entry and micros - entry["at"] < ttl_micros:
            return True, entry["id"], (micros - entry["at"]) // 1_000_000
        entry.clear()
        if storable:
            entry.update(at=micros, id=row_id)
        return False, None, None

    return step


def _with_segments(df: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    timed = (df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_chunk", hour_chunk(ts)))
    return gap_segments(timed, key, "_us", tie, seconds * 1_000_000, "_chunk", "_segment").drop("_chunk")


def rate_limit(df: DataFrame, client: str = "client", ts: str = "ts", tie: str = "request_id", limit: int = fv.RATE_LIMIT_MAX,
               seconds: int = fv.RATE_LIMIT_SECONDS, out: str = "allowed") -> DataFrame:
    """Whether a request is accepted: fewer than ``limit`` accepted ones in the window before it.

    Rejected requests do not count, so this is decided in order. A pause of a
    whole window resets the state; requests are processed in runs between such
    pauses, not as whole clients.
    """
    segments = _with_segments(df, client, ts, tie, seconds)
    done = _sequential(segments, [client, "_segment"], ["_us", tie], deque, limiter_step(limit, seconds * 1_000_000),
                       {out: BooleanType()}, ["_us"])
    return done.select(*df.columns, out)


def ttl_cache(df: DataFrame, key: str, ts: str = "ts", tie: str = "request_id", ttl_seconds: int = fv.ANSWER_TTL_SECONDS,
              storable: str = "storable") -> DataFrame:
    """Cache behaviour per key: adds ``from_cache``, ``served_id`` (the row that filled the entry), ``age_seconds``.

    A hit does not renew the entry. Only rows with ``storable`` fill it.
    """
    segments = _with_segments(df, key, ts, tie, ttl_seconds)
    id_type = df.schema[tie].dataType
    done = _sequential(segments, [key, "_segment"], ["_us", tie], dict, cache_step(ttl_seconds * 1_000_000),
                       {"from_cache": BooleanType(), "served_id": id_type, "age_seconds": LongType()}, ["_us", tie, storable])
    return done.select(*df.columns, "from_cache", "served_id", "age_seconds")


def response_cache(df: DataFrame, ts: str = "ts", tie: str = "request_id", ttl_seconds: int = fv.ANSWER_TTL_SECONDS) -> DataFrame:
    """Answer cache over (question, intent, validation_warnings): keyed by the normalised
    question across all sessions; only STATIC answers without warnings are stored."""
    storable = (F.col("intent") == "STATIC") & (F.size("validation_warnings") == 0)
    keyed = (df.withColumn("question_key", tx.question_key("question"))
             .withColumn("storable", F.coalesce(storable, F.lit(False))))
    return ttl_cache(keyed, "question_key", ts, tie, ttl_seconds)
