"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, LongType, StringType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railweave import fixed_values as fv
from railweave.operators.sessions import cache_step, limiter_step


def _micros(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))


def _stateful(df: DataFrame, key: str, ts: str, tie: str, out_fields: dict[str, DataType], state_ddl: str, load, save, step, read) -> DataFrame:
    """Runs ``step`` over the rows of each key in event order; state outlives the batch."""
    schema = StructType(df.schema.fields + [StructField(name, kind) for name, kind in out_fields.items()])
    names = df.columns

    def run(_, batches, group: GroupState):
        # rows of one key within one micro-batch, whose size the trigger bounds
        pdf = pd.concat([b for b in batches if len(b)]).sort_values(["_us", tie])
        state = load(group.get if group.exists else None)
        results = [step(state, *values) for values in zip(*[pdf[c] for c in read])]
        group.update(save(state))
        columns = list(zip(*results))
        yield pdf[names].assign(**{n: pd.Series(list(c), index=pdf.index, dtype=object) for n, c in zip(out_fields, columns)})

    return _micros(df, ts).groupBy(key).applyInPandasWithState(run, schema, state_ddl, "append", GroupStateTimeout.NoTimeout)


def stream_rate_limit(df: DataFrame, client: str = "client", ts: str = "ts", tie: str = "request_id", limit: int = fv.RATE_LIMIT_MAX,
                      seconds: int = fv.RATE_LIMIT_SECONDS, out: str = "allowed") -> DataFrame:
    return _stateful(df, client, ts, tie, {out: BooleanType()}, "accepted array<bigint>",
                     lambda s: deque(s[0] if s else ()), lambda s: (list(s),),
                     limiter_step(limit, seconds * 1_000_000), ["_us"])


def stream_ttl_cache(df: DataFrame, key: str, ts: str = "ts", tie: str = "request_id", ttl_seconds: int = fv.ANSWER_TTL_SECONDS,
                     storable: str = "storable") -> DataFrame:
    id_type = df.schema[tie].dataType
    return _stateful(df, key, ts, tie, {"from_cache": BooleanType(), "served_id": id_type, "age_seconds": LongType()},
                     f"at bigint, id {id_type.simpleString()}",
                     lambda s: dict(at=s[0], id=s[1]) if s and s[0] is not None else {},
                     lambda s: (s.get("at"), s.get("id")),
                     cache_step(ttl_seconds * 1_000_000), ["_us", tie, storable])


def stream_carry_train(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "question_id",
                       value: str = "train_no", out: str = "session_train") -> DataFrame:
    def step(state: dict, current):
        if current is not None and current == current:
            state["v"] = current
        return (state.get("v"),)

    return _stateful(df, session, ts, tie, {out: StringType()}, "v string", lambda s: {"v": s[0]} if s and s[0] is not None else {},
                     lambda s: (s.get("v"),), step, [value])


def stream_query_stats(log: DataFrame, ts: str = "ts", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts, mean response time and errors per window and intent, over an append-only log."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (timed.groupBy(F.window(ts, every).alias("w"), F.coalesce("intent", F.lit("UNKNOWN")).alias("intent"))
            .agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("response_time_ms"), 1).alias("avg_response_time_ms"),
                 F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("errors"))
            .select(F.col("w.start").alias("window_start"), "intent", "queries", "avg_response_time_ms", "errors"))
