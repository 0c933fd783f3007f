"""Sessions over a stream, in event order and with a time to live.

Rows of a session wait in typed list state until the watermark has passed them, so rows
that come late, but within the allowed delay, take their place in time and results equal
those of the batch forms whatever the arrival order. A timer per session processes what
is due; after ``ttl`` without a row another one clears all of the session's state.

The state store must be RocksDB (``state_store``), which keeps state on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, ShortType, StringType, StructField, StructType

from railweave import fixed_values as fv
from railweave.functions import text as tx

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL, LATE = "6 hours", "30 minutes"
_WHOLE = (LongType, IntegerType, ShortType)


def state_store(spark: SparkSession) -> None:
    """Lets streams that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Hands each session's rows, in event order, to ``step(memory, row) -> value``; memory is a list of texts."""

    def __init__(self, schema: StructType, tie: str, ttl_micros: int, step):
        self.schema, self.tie, self.ttl, self.step = schema, schema.names.index(tie), ttl_micros, step
        self.at, self.whole = schema.names.index("stream_us"), [isinstance(f.dataType, _WHOLE) for f in schema]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.memory = handle.getListState("memory", StructType([StructField("text", StringType())]))
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def _plain(self, values) -> tuple:
        return tuple(None if x is None or x != x else int(x) if whole else x for x, whole in zip(values, self.whole, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # rows that the watermark has passed are too late, as everywhere in Spark
        new = [r for pdf in rows for r in map(self._plain, pdf.itertuples(index=False, name=None)) if r[self.at] // 1000 >= passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[self.at] for r in new) // 1000 + 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rows = [self._plain(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[self.at] // 1000 < passed), key=lambda r: (r[self.at], r[self.tie] is not None, r[self.tie]))
        rest = [r for r in rows if r[self.at] // 1000 >= passed]
        memory = [r[0] for r in self.memory.get()] if self.memory.exists() else []
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for row in due:
            if last is not None and row[self.at] - last >= self.ttl:
                memory = []
            memory, value = self.step(memory, dict(zip(self.schema.names, row, strict=True)))
            out.append((*row, value))
            last = row[self.at]
        self.waiting.put(rest) if rest else self.waiting.clear()
        if not rest and (last is None or passed >= (last + self.ttl) // 1000):
            self.memory.clear()
            self.last.clear()
        else:
            self.memory.put([(x,) for x in memory]) if memory else self.memory.clear()
            if last is not None:
                self.last.update((last,))
            following = [r[self.at] // 1000 + 1 for r in rest] + [(last + self.ttl) // 1000 + 1] * (last is not None)
            self.handle.registerTimer(min(x for x in following if x > passed))
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [*self.schema.names, "stream_out"]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    def close(self) -> None:
        pass


def _sessions(df: DataFrame, session: str, ts: str, tie: str, out: str, ttl: str, late: str, step) -> DataFrame:
    micros = df.sparkSession.range(1).select(F.expr(f"cast(interval {ttl} as interval day to second)").alias("i")).select(
        F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.col("i"))).first()[0]
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("stream_us", F.unix_micros(ts))
    kept = [c for c in df.columns if c != ts]
    schema = StructType([f for f in timed.select("stream_us", *kept).schema])
    # the event-time column stays in the input, for the watermark
    found = timed.select("stream_us", *kept, ts, F.col(session).alias("stream_key")).groupBy("stream_key").transformWithStateInPandas(
        statefulProcessor=_Narrow(schema, tie, micros, step), outputStructType=StructType([*schema.fields, StructField("stream_out", StringType())]), outputMode="Append", timeMode="EventTime")
    return found.select(*(F.timestamp_micros("stream_us").alias(ts) if c == ts else F.col(c) for c in df.columns), F.col("stream_out").alias(out))


class _Narrow(InOrder):
    """Drops the event-time column of the input, which is there in micros."""

    def handleInputRows(self, key, rows, timerValues):
        yield from super().handleInputRows(key, (pdf[self.schema.names] for pdf in rows), timerValues)


def stream_session_train(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "question_id", value: str = "train_no",
                         out: str = "session_train", ttl: str = TTL, late: str = LATE) -> DataFrame:
    """``sessions.carry_train`` over a stream: the latest train of the session up to each row, forgotten after ``ttl`` without rows.

    Rows without a session are one session; values are text.
    """
    def step(memory: list[str], row: dict):
        memory = memory if row[value] is None else [row[value]]
        return memory, memory[0] if memory else None

    return _sessions(df, session, ts, tie, out, ttl, late, step)


def stream_recent_turns(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "turn_id", question: str = "question", answer: str = "answer",
                        turns: int = fv.HISTORY_TURNS, out: str = "history", ttl: str = TTL, late: str = LATE) -> DataFrame:
    """``sessions.recent_turns`` over a stream: the pairs before each turn as text, forgotten after ``ttl`` without a turn."""
    pair = F.concat(F.lit("User: "), F.col(question), F.lit("\nAssistant: "), tx.preview(answer))

    def step(memory: list[str], row: dict):
        history = fv.HISTORY_HEADER + "\n".join(x for x in memory if x is not None) + "\n" if memory else ""
        return [*memory, row["stream_pair"]][-turns:], history

    return _sessions(df.withColumn("stream_pair", pair), session, ts, tie, out, ttl, late, step).drop("stream_pair")
