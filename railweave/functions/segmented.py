"""Per-key scans that do not put a whole key into one task.

A key (client, session, question text) may own a large share of all rows. Each
helper splits the key by a *chunk* column that follows the order (an hour, a
block number), scans inside (key, chunk), and stitches the chunks through a
summary with one row per (key, chunk). The scan, the summary and the join back
share the partitioning on (key, chunk), so the rows are shuffled once. The
results are exact; no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def carry_last(df: DataFrame, keys, order, value: str, chunk: str, out: str) -> DataFrame:
    """Latest non-null ``value`` of the key up to and including the row."""
    keys, order = _names(keys), _names(order)
    within = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    scanned = df.withColumn("_local", F.last(value, ignorenulls=True).over(within))
    summary = (df.groupBy(*keys, chunk)
               .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_v"))
               .withColumn("_carry", F.last("_v", ignorenulls=True).over(before)).drop("_v"))
    return (scanned.join(summary, [*keys, chunk], "left")
            .withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry"))


def dense_position(df: DataFrame, keys, order, chunk: str, out: str) -> DataFrame:
    """Zero-based position of the row inside its key."""
    keys, order = _names(keys), _names(order)
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    summary = (df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, chunk).orderBy(*order)))
            .join(summary, [*keys, chunk], "left")
            .withColumn(out, (F.col("_offset") + F.col("_rn") - 1).cast("bigint")).drop("_rn", "_offset"))


def preceding_rows(df: DataFrame, keys, position: str, n: int, columns, out: str, block: int = 512) -> DataFrame:
    """Up to ``n`` rows before each row, oldest first, as an array of structs.

    ``position`` is dense (see ``dense_position``). Rows are grouped in blocks of
    equal size; the last ``n`` rows of a block are repeated in the next one as
    its left edge, so no window spans more than ``block + n`` rows.
    """
    keys = _names(keys)
    p = F.col(position)
    home = F.floor(p / block)
    tagged = df.withColumn("_block", F.explode(
        F.when(F.pmod(p, F.lit(block)) >= block - n, F.array(home, home + 1)).otherwise(F.array(home))))
    w = W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-n, -1)
    return (tagged.withColumn(out, F.collect_list(F.struct(*columns)).over(w))
            .where(F.col("_block") == home).drop("_block"))


def gap_segments(df: DataFrame, keys, micros: str, tie: str, gap_micros: int, chunk: str, out: str) -> DataFrame:
    """Start (micros) of the run of rows in which neighbours are closer than the gap.

    State that lives for at most ``gap_micros`` cannot pass a gap, so runs can be
    processed apart from each other.
    """
    keys = _names(keys)
    within = W.partitionBy(*keys, chunk).orderBy(micros, tie)
    running = within.rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    t = F.col(micros)
    starts = (df.withColumn("_prev", F.lag(micros).over(within))
              .withColumn("_start", F.when(t - F.col("_prev") >= gap_micros, t))
              .withColumn("_local", F.max("_start").over(running)))
    summary = (starts.groupBy(*keys, chunk)
               .agg(F.min(micros).alias("_min"), F.max(micros).alias("_max"), F.max("_start").alias("_last"))
               .withColumn("_prev_max", F.max("_max").over(before))
               .withColumn("_first", F.when(F.col("_prev_max").isNull()
                                            | (F.col("_min") - F.col("_prev_max") >= gap_micros), F.col("_min")))
               .withColumn("_carry", F.last(F.coalesce("_last", "_first"), ignorenulls=True).over(before))
               .select(*keys, chunk, "_first", "_carry"))
    return (starts.join(summary, [*keys, chunk], "left")
            .withColumn(out, F.coalesce("_local", "_first", "_carry"))
            .drop("_prev", "_start", "_local", "_first", "_carry"))


def hour_chunk(ts: str | Column) -> Column:
    return F.date_trunc("hour", F.col(ts) if isinstance(ts, str) else ts)
