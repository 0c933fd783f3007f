"""Benchmark decontamination with DataFrame operations only.

A window is 13 consecutive words of a benchmark item; an item with fewer words is one
window. Each text is read once and cut into chunks at fixed steps, such that every
window contains exactly one whole chunk. Chunk hashes meet the set of chunk hashes of
the benchmark; around a match the windows are cut out and compared as words. A
text's words never leave the scan unless a chunk of it matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.functions.runtime import materialise
from railweave.llm.common import LOWER, UPPER

WINDOW = 13
#: Contaminated: n_hit > 0 and SHARE * n_hit >= n_words.
SHARE = 20
#: The benchmark's hashes are broadcast up to this many rows (16 and about 120 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000

#: ASCII characters that separate words, once A-Z are lower-cased.
SEPARATORS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    mapped = F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.coalesce(F.array_remove(F.split(mapped, " "), ""), F.array().cast("array<string>"))


def _chunk(length: int) -> tuple[int, int]:
    """Words of a chunk and the step between chunks, for windows of ``length`` words."""
    size = (length + 1) // 2
    return size, length - size + 1


def _joined(array: Column, start: Column, length: int | Column) -> Column:
    return F.concat_ws(" ", F.slice(array, start + 1, length))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, length, win, ws): every window of every item, as text and as words."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w"))
    length = F.least(F.size("w"), F.lit(window))
    return (items.filter(F.size("w") > 0).withColumn("length", length)
            .select("item", "length", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("p"))
            .select("item", "length", F.slice("w", F.col("p") + 1, F.col("length")).alias("ws"))
            .withColumn("win", F.concat_ws(" ", "ws")).distinct())


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(found, items): a row per text and per hit window, and the items of each window.

    found: doc_id, t1, t2 (digest of the text), n_words, and for hits p (word position),
    length, win; a text's own row has null there.
    """
    windowed = materialise(windows(benchmark, window=window), "windows")
    n_windows = windowed.count()
    lengths = sorted(r["length"] for r in windowed.select("length").distinct().collect())
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"),
                         words(F.col(text)).alias("w")).withColumn("n_words", F.size("w"))
    own = F.array(F.struct(F.lit(0).alias("length"), F.lit(-1).alias("q"), F.lit(0).cast("long").alias("h")))

    def probes(length: int) -> Column:
        size, step = _chunk(length)
        at = F.when(F.col("n_words") >= length, F.sequence(F.lit(0), F.col("n_words") - size, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda q: F.struct(F.lit(length).alias("length"), q.alias("q"), F.xxhash64(F.lit(length), F.slice("w", q + 1, size)).alias("h")))

    def grams(length: int) -> DataFrame:
        size, step = _chunk(length)
        return (windowed.filter(F.col("length") == length).select("length", "ws", F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("o"))
                .select("length", F.xxhash64(F.lit(length), F.slice("ws", F.col("o") + 1, size)).alias("h")).distinct())

    probed = source.select("doc_id", "t1", "t2", "n_words", "w", F.inline(F.concat(own, *map(probes, lengths))))
    if not lengths:
        found = probed.select("doc_id", "t1", "t2", "n_words", F.lit(None).cast("int").alias("p"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("win"))
        return found, windowed.select("win", "item")
    known = reduce(DataFrame.unionByName, map(grams, lengths)).withColumn("known", F.lit(True))
    matched = probed.join(_sized(known, n_windows * window), ["length", "h"], "left").filter("known or q < 0")

    sizes = F.create_map(*[F.lit(x) for n in lengths for x in (n, _chunk(n)[0])])
    size = sizes[F.col("length")]
    low, high = F.greatest(F.lit(0), F.col("q") - (F.col("length") - size)), F.least("q", F.col("n_words") - F.col("length"))
    around = F.when(F.col("q") < 0, F.array(F.struct(F.lit(None).cast("int").alias("p"), F.lit(None).cast("string").alias("win")))).otherwise(
        F.when(low <= high, F.transform(F.sequence(low, high), lambda p: F.struct(p.alias("p"), _joined(F.col("w"), p, F.col("length")).alias("win")))))
    cut = matched.select("doc_id", "t1", "t2", "n_words", "length", F.inline(around))
    real = windowed.select("length", "win").distinct().withColumn("real", F.lit(True))
    found = cut.join(_sized(real, n_windows), ["length", "win"], "left").filter("real or p is null")
    return found.select("doc_id", "t1", "t2", "n_words", "p", F.when(F.col("p").isNotNull(), F.col("length")).alias("length"), "win"), windowed.select("win", "item").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (their ids, sorted), contaminated.

    Null and empty texts have no words and are clean. Repeated rows give repeated,
    equal results; doc_id may be null or repeated. An item without words has no window,
    an item without id counts under the empty id. Other columns are ignored.
    """
    found, items = find(docs, benchmark, doc_id, text)
    found = materialise(found, "found")
    key = ["doc_id", "t1", "t2"]
    span = F.struct(F.col("p"), (F.col("p") + F.col("length")).alias("e"))
    own = found.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count(F.when(F.col("p").isNull(), 1)).alias("copies"),
                                  F.array_sort(F.collect_set(F.when(F.col("p").isNotNull(), span))).alias("spans"))
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["e"], x["e"]).alias("e"), (s["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(s["e"], x["p"]))).alias("n")))["n"]
    listed = (found.filter("p is not null").select(*key, "win").distinct().join(items, "win").groupBy(*key)
              .agg(F.array_sort(F.collect_set("item")).alias("items")).withColumnsRenamed({k: f"_{k}" for k in key}))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    out = own.withColumn("n_hit", covered.cast("long")).join(listed, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n_words = F.col("n_words").cast("long")
    return out.select("doc_id", "t1", "t2", n_words.alias("n_words"), "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= n_words)).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they were, without the contaminated ones."""
    dirty = hits(docs, benchmark, doc_id, text).filter("contaminated").select(F.col("doc_id").alias("_dirty_id"), F.col("t1").alias("_dirty_1"), F.col("t2").alias("_dirty_2")).distinct()
    same = (docs[doc_id].eqNullSafe(F.col("_dirty_id")) & (F.xxhash64(docs[text]) == F.col("_dirty_1")) & (F.xxhash64(F.lit(1), docs[text]) == F.col("_dirty_2")))
    return docs.join(dirty, same, "left_anti")
