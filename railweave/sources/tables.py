"""Readers and writers for tables, collections, the question log and evaluation sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railweave.functions import text as tx
from railweave.functions.runtime import materialise

QUERY_LOG = {
    "ts": "string", "question": "string", "intent": "string", "confidence": "double", "train_no": "string", "num_docs": "int",
    "avg_relevance_score": "double", "response_time_ms": "double", "source": "string", "live_api_used": "boolean",
    "live_api_success": "boolean", "error": "string", "validation_warnings": "array<string>",
}
EVAL_CASE = {"question": "string", "expected_keywords": "array<string>", "category": "string", "intent": "string"}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def _missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "csv",
               multi_line: bool = False) -> DataFrame:
    """A table with a fixed schema, null tokens turned into NULL; a missing path gives an empty table.

    Identifiers should be declared as strings, so that leading zeros survive.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", "\"").option("multiLine", multi_line)
    try:
        return tx.clean_nulls(reader.format(fmt).load(path))
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], schema)
        raise


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(ddl(QUERY_LOG)).option("mode", "FAILFAST").json(path)


def log_records(df: DataFrame, chars: int | None = None) -> DataFrame:
    """Rows in the shape of the question log: no NULL warnings, the question whole or its first ``chars`` characters."""
    have = set(df.columns)
    out = df if chars is None else df.withColumn("question", F.substring("question", 1, chars))
    if "validation_warnings" in have:
        out = out.withColumn("validation_warnings",
                             F.coalesce("validation_warnings", F.array().cast("array<string>")))
    else:
        out = out.withColumn("validation_warnings", F.array().cast("array<string>"))
    for name, default in (("live_api_used", False), ("live_api_success", False)):
        out = out.withColumn(name, F.coalesce(name, F.lit(default)) if name in have else F.lit(default))
    if "source" not in have:
        out = out.withColumn("source", F.lit("unknown"))
    for name, kind in QUERY_LOG.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.select(*[F.col(name).cast(kind) for name, kind in QUERY_LOG.items()])


def append_query_log(df: DataFrame, path: str, chars: int | None = None) -> None:
    log_records(df, chars).write.mode("append").option("ignoreNullFields", False).json(path)


def read_collection(spark: SparkSession, root: str, collection: str | None = None,
                    where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Documents of a collection; the collection is a partition column, so others are not listed."""
    df = spark.read.parquet(root)
    if collection is not None:
        df = df.where(F.col("collection") == collection)
    if where is not None:
        df = df.where(where)
    return df if limit is None else df.limit(limit)


def document_id(*key: str | Column) -> Column:
    """Stable id from the natural key, the same in every run."""
    return F.xxhash64(*[tx.col(k) for k in key])


#: Columns by which documents are looked up.
LOOKUP_KEYS = ("doc_id", "train_no", "station_code")


def write_collection(df: DataFrame, root: str, rows_per_file: int = 1_000_000, keys=LOOKUP_KEYS, block_bytes: int | None = None) -> None:
    """Replace the collections that occur in ``df`` and leave the others alone.

    The rows are spread over files by size, so one large collection does not end
    up in a single writer. Files are sorted by the first of ``keys`` that ``df`` has, so
    their statistics are narrow, and hold a Bloom filter of each of them, whose size
    follows the number of values: a lookup by key (``point_lookup``) skips the row groups
    that cannot hold it. ``block_bytes`` is the size of a row group.
    """
    present = [k for k in keys if k in df.columns]
    writer = (df.sortWithinPartitions("collection", *present[:1]).write.partitionBy("collection").mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).option("parquet.bloom.filter.adaptive.enabled", True))
    for k in present:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", True)
    if block_bytes is not None:
        writer = writer.option("parquet.block.size", block_bytes)
    writer.parquet(root)


def missing_rows(new: DataFrame, stored: DataFrame, key) -> DataFrame:
    """Rows whose key is not stored yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return new.join(stored.select(*keys), keys, "left_anti")


def append_missing(df: DataFrame, root: str, key=("collection", "doc_id")) -> DataFrame:
    """Append what is not stored yet; running it twice changes nothing. Returns the appended rows.

    The batch is evaluated once. Only the partitions of its collections are read, which a
    join on the partition column prunes; collections are not listed on the driver.
    """
    batch = materialise(df.dropDuplicates(list(key)), "batch")
    if batch.isEmpty():  # an empty batch leaves nothing behind
        return batch
    try:
        # the batch's schema, as a store may hold no file yet
        stored = df.sparkSession.read.schema(df.schema).parquet(root)
    except AnalysisException as error:
        if not _missing(error):
            raise
        stored = df.limit(0)
    named = stored.join(batch.select("collection").distinct(), "collection", "left_semi")
    known = named.select(*key).unionByName(stored.where(F.col("collection").isNull()).select(*key))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    todo = materialise(batch.alias("b").join(known.alias("k"), same, "left_anti"), "missing")
    todo.write.partitionBy("collection").mode("append").parquet(root)
    return todo


#: Ranges into which one counting pass cuts the keys, keys sampled for the cuts, rows that are sorted at last.
RANGES, SAMPLED_KEYS, SORTED_ROWS = 64, 4096, 200_000


def _cuts(df: DataFrame, key: str, total: int) -> list:
    """Keys that cut the rows into about RANGES parts, from a sample of bounded size; any cuts give right pages."""
    seen = df.select(key).where(F.col(key).isNotNull())
    keys = sorted(r[0] for r in seen.where(F.rand(7) < min(1.0, SAMPLED_KEYS / max(1, total))).limit(2 * SAMPLED_KEYS).collect())
    return sorted({keys[len(keys) * i // RANGES] for i in range(1, RANGES)}) if keys else []


def rows_between(df: DataFrame, keys: list[str], start: int, end: int, total: int | None = None, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Rows [start, end) in key order, nulls first, without sorting the table.

    A pass over the first key counts the rows of each range; sums of the counts tell which
    ranges hold the rows wanted, and only those are read on, through a filter that the
    scan can use. That repeats inside them until few rows are left or all have one key,
    in which case the next key goes on. What is sorted at last is the page and at most
    about ``sorted_rows`` rows beside it; rows equal in all keys are in no order.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"] if total is None else total
    part, key, left = df, 0, total
    end = min(end, total)
    while key < len(keys) and start < end and left > max(sorted_rows, 2 * (end - start)):
        name = keys[key]
        cuts = _cuts(part, name, left)
        place = F.when(F.col(name).isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(name)))) if cuts else F.when(F.col(name).isNull(), -1).otherwise(0)
        counts = sorted((r["p"], r["n"], r["a"], r["b"]) for r in part.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("a"), F.max(name).alias("b")).collect())
        before, first, last = 0, None, None
        for p, n, low, high in counts:  # RANGES rows and one
            if before + n > start and first is None:
                first, skipped, lowest, held = p, before, low, 0
            if first is not None and last is None:
                held, highest = held + n, high
                if before + n >= end:
                    last = p
            before += n
        # a range without a lowest key is that of nulls
        inside = F.col(name).isNull() if first == -1 else F.col(name) >= F.lit(lowest)
        if last == -1:
            part = part.where(F.col(name).isNull())
        else:
            part = part.where((F.col(name) <= F.lit(highest)) | F.col(name).isNull() if first == -1 else inside & (F.col(name) <= F.lit(highest)))
        start, end = start - skipped, end - skipped
        if first == last and (first == -1 or lowest == highest):
            key += 1  # one key: the next one tells the rows apart
        elif held == left:
            break
        left = held
    ordered = part.orderBy(*keys[key:]) if key < len(keys) else part
    return ordered.limit(max(end, 0)).offset(start) if start < end else df.limit(0)


def page_table(df: DataFrame, key, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in key order, with the total row count on each row.

    Deep pages are found by counted ranges (``rows_between``); the count reads no columns.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).first()["total"]
    keys = [key] if isinstance(key, str) else list(key)
    return rows_between(df, keys, offset, offset + limit, total).withColumn("total", F.lit(total))


def point_lookup(df: DataFrame, key: str, value: str, first_by: str | None = None) -> DataFrame:
    """Rows by key. With ``first_by`` the compare is upper-cased and only the first row is kept."""
    if first_by is None:
        return df.where(F.col(key) == value)
    return df.where(F.upper(key) == value.upper()).orderBy(first_by).limit(1)


def list_all(df: DataFrame) -> DataFrame:
    """All rows together with their count."""
    return df.withColumn("total", df.agg(F.count(F.lit(1))).scalar())


def slice_rows(df: DataFrame, key, start: int, end: int) -> DataFrame:
    """Rows [start, end) in key order, see ``rows_between``."""
    return rows_between(df, [key] if isinstance(key, str) else list(key), start, end)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ddl(EVAL_CASE)).option("multiLine", True).json(path)


def write_eval_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
