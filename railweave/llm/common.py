"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that one step of a scan holds in Python; longer Arrow batches are cut.
BATCH_ROWS = 1024
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about BATCH_BYTES of text; a longer text comes alone."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64,
                                      count=len(column) + 1, offset=column.offset * (4 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else 8))) if len(column) else []
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > BATCH_BYTES or i - start >= BATCH_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(batch) > start:
            yield batch.slice(start)


def scan(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType, text: str = "text") -> DataFrame:
    """Apply ``fn`` to bounded slices of the Arrow batches."""
    def run(batches):
        for part in slices(batches, text):
            yield fn(part)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, as a worker lives on after its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hash_cut(df: DataFrame, key: str, n: int) -> Column:
    """Condition that at most n rows meet, those whose hashed keys come first.

    The share of rows that may matter is known from their count, so only about n
    hashes are ordered, whatever the size of the table.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 53))
    total = df.count()
    share = 1 << 53 if total <= 2 * n else int((1 << 53) * 2 * n / total)
    first = df.select(place.alias("h")).filter(F.col("h") < share).orderBy("h").limit(n + 1).agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    return place < (first["h"] if first["n"] > n else share)


def stratified(df: DataFrame, by: str, n: int, least: int = 20) -> DataFrame:
    """At most n rows of ``df``, dealt evenly over the values of ``by``, by the hash of the whole row.

    Equal rows count once, so neither a repeated key nor a repeated row keeps others out.
    Values with few rows give all of them and the others share the rest; with more than
    n / least values the most frequent ones are drawn from. Null values give no row.
    """
    place = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 53))
    # at most n / least rows
    known = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.approx_count_distinct(place).alias("rows")).orderBy(F.desc("rows"), by).limit(max(1, n // least)).collect()
    quotas, left = [], n
    for k, row in enumerate(sorted(known, key=lambda r: (r["rows"], str(r[by])))):
        # the count of distinct rows is an estimate, so its double may still be all
        quota = min(max(1, 2 * row["rows"]), left // (len(known) - k))
        left -= quota
        quotas.append((row[by], quota, min(1 << 53, int((1 << 53) * 2.0 * quota / max(1, row["rows"])))))
    if not quotas:
        return df.limit(0)
    # literals, at most n / least, so the rows are cut where they are read
    at = F.array_position(F.array(*(F.lit(x) for x, _, _ in quotas)), F.col(by)).cast("int") - 1
    of = lambda k: F.get(F.array(*(F.lit(x[k]).cast("long") for x in quotas)), at)
    near = df.filter(F.col(by).isNotNull()).withColumn("_place", place).filter(F.col("_place") < of(2)).dropDuplicates([by, "_place"])
    first = F.row_number().over(Window.partitionBy(by).orderBy("_place"))
    return near.withColumn("_n", first).filter(F.col("_n") <= of(1)).select(*df.columns)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C17
_SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            out.append(np.multiply.accumulate(column))
        _powers[:] = out
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word of a buffer; words are what white space separates.

    A polynomial over the word's bytes, read off running sums, then mixed with its length.
    """
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(data)]])
    start, end = edge[0::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, side="right")))
        low, high = int(start[at]), int(end[stop - 1])
        power, inverse = _tables(max(_SEGMENT, high - low))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[:high - low], out=sums[1:])
        first, last = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mix64((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return start, out


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as executors need not have it."""
    import os
    import tempfile
    import zipfile

    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="railweave-"), "railweave-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "railweave")):
            for name in sorted(n for n in names if n.endswith(".py")):
                archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[application] = path
