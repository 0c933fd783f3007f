"""Live payloads as streams: duplicates dropped, the newest observation of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def distinct_observations(observations: DataFrame, keys: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """Each observation once; a repeat is known as long as the watermark has not passed it."""
    return observations.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_first_success(tries: DataFrame, keys: list[str], ts: str = "ts", every: str = "5 minutes", priority: str = "priority", success: str = "success",
                         late: str = LATE, error: str = "all sources failed") -> DataFrame:
    """``live.first_success`` per key and window of ``every``: the best source's successful record, or the error."""
    timed = tries.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rest = [c for c in tries.columns if c not in (*keys, ts)]
    best = F.min_by(F.struct(*rest), F.when(F.col(success), F.col(priority)))
    out = timed.groupBy(F.window(ts, every).alias("_w"), *keys).agg(best.alias("_b"))
    found = out.select(F.col("_w.start").alias("window_start"), *keys, *(F.col(f"_b.{c}").alias(c) for c in rest))
    return found.withColumn(success, F.coalesce(success, F.lit(False))).withColumn("error", F.when(~F.col(success), error))


def stream_latest_within_ttl(requests: DataFrame, observations: DataFrame, ttl_seconds: int, key: str = "key", at: str = "ts", request_id: str = "request_id",
                             value: str = "value", late: str = LATE) -> DataFrame:
    """``live.latest_within_ttl`` over two streams: each request with the newest observation younger than the TTL.

    An interval join bounds the state of both sides by the TTL and the allowed delay. A
    request's row comes when the watermarks have passed it, so observations that arrive
    after it but happened before it count. Repeated observations count once.
    """
    seen = distinct_observations(observations, [key, at, value], at, late).select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.col(value).alias("_v"))
    asked = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    met = asked.join(seen, (F.col(key) == F.col("_k")) & (F.col("_at") <= F.col(at)) & (F.col("_at") > F.col(at) - F.expr(f"INTERVAL {ttl_seconds} SECONDS")), "leftOuter")
    newest = F.max(F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.xxhash64("_v").alias("tie"), F.col("_v").alias("v"))))
    out = met.groupBy(F.window(at, "1 second").alias("_w"), F.unix_micros(at).alias("_t"), key, request_id).agg(newest.alias("_o"))
    micros = F.col("_t") - F.unix_micros("_o.at")
    return out.select(key, request_id, F.timestamp_micros("_t").alias(at), F.col("_o.v").alias(value), F.col("_o").isNotNull().alias("from_cache"), F.floor(micros / 1_000_000).alias("age_seconds"))
