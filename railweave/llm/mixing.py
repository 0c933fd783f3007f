"""Mixing sources to target weights by pivotal dependent rounding, DataFrame operations only.

Every document of a source should appear target / source_size times. The whole part is
sure; the fraction is a probability that has to become 0 or 1. Two documents at a time
exchange probability, measured in words, until one of them is decided; which way is
drawn so that expectations hold, and the words of the pair stay the same. Buckets of a
bounded number of documents leave one undecided document each, and these meet in the
next level of a tree, up to one per source. So a source's words miss its target by half a
document at most.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railweave.functions.runtime import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATIO = 3
#: Documents of a bucket, on average; the tree's fan-in.
FAN_IN = 128
SEED = 17
#: The table of sources is broadcast up to this many rows (under 100 bytes each, but for their names).
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Number of words, which white space separates; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_ratio: int = MAX_RATIO) -> DataFrame:
    """Per source: source, n, source_size, target.

    Sources in code point order, null last, take the weights in turn. All words are
    shared by weight, no source gets more than max_ratio times its words, and what is
    over goes to the others by weight. In the order of limit per weight, the sources up
    to some place are at their limit and the others share the rest.
    """
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    # windows over one row per source
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * float(max_ratio)
    order = W.orderBy(limit / F.col("weight"), F.asc_nulls_last("source"))
    everything = W.partitionBy()
    before, behind = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    filled = weighed.withColumn("limit", limit).withColumn("level", level).withColumn("place", F.row_number().over(order))
    below = F.col("level") * F.col("weight") <= F.col("limit")
    rest = F.min(F.when(below, F.struct("place", "level"))).over(everything)["level"]
    return filled.withColumn("rest", rest).select("source", "n", "source_size", F.least("limit", F.coalesce(F.col("rest") * F.col("weight"), F.col("limit"))).alias("target"))


def _uniform(*of) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _round_buckets(units: DataFrame) -> DataFrame:
    """Pivotal rounding within buckets. units: source_no, bucket, k1, k2, dup, size, p, u.

    Returns source_no, bucket, open (the undecided document or null) and done (k1, k2,
    dup, extra of the others).
    """
    item = F.struct("u", "k1", "k2", "dup", "size", "p")
    grouped = units.groupBy("source_no", "bucket").agg(F.array_sort(F.collect_list(item)).alias("items"))
    held = "struct<u:double,k1:bigint,k2:bigint,dup:int,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(held).alias("open"), F.array().cast("array<struct<k1:bigint,k2:bigint,dup:int,extra:int>>").alias("done"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["u"].alias("u"), x["k1"].alias("k1"), x["k2"].alias("k2"), x["dup"].alias("dup"), x["size"].alias("size"), p.alias("p"))

    def decided(x: Column, extra: Column) -> Column:
        return F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["dup"].alias("dup"), extra.cast("int").alias("extra"))

    def settle(done: Column, a: Column, b: Column) -> Column:
        # a, b: the pair with new probabilities, of which one at least is 0 or 1
        def whole(x):
            return (x["p"] <= 0) | (x["p"] >= 1)

        def close(x):
            return decided(x, F.when(x["p"] >= 1, 1).otherwise(0))

        none = F.lit(None).cast(held)
        return (F.when(whole(a) & whole(b), F.struct(none.alias("open"), F.concat(done, F.array(close(a), close(b))).alias("done")))
                .when(whole(a), F.struct(b.alias("open"), F.concat(done, F.array(close(a))).alias("done")))
                .otherwise(F.struct(a.alias("open"), F.concat(done, F.array(close(b))).alias("done"))))

    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        up, down = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]), F.least((1 - b["p"]) * b["size"], a["p"] * a["size"])
        rises = _uniform(F.lit(SEED), a["k1"], a["dup"], b["k1"], b["dup"]) * (up + down) < down
        a_full, b_full = (1 - a["p"]) * a["size"] <= b["p"] * b["size"], (1 - b["p"]) * b["size"] <= a["p"] * a["size"]
        pa = F.when(rises, F.when(a_full, 1.0).otherwise(a["p"] + up / a["size"])).otherwise(F.when(b_full, a["p"] - down / a["size"]).otherwise(0.0))
        pb = F.when(rises, F.when(a_full, b["p"] - up / b["size"]).otherwise(0.0)).otherwise(F.when(b_full, 1.0).otherwise(b["p"] + down / b["size"]))
        return F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).otherwise(settle(state["done"], with_p(a, pa), with_p(b, pb)))

    return grouped.select("source_no", "bucket", F.aggregate("items", start, step).alias("state")).select("source_no", "bucket", "state.open", "state.done")


def copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, max_ratio: int = MAX_RATIO,
           fan_in: int = FAN_IN) -> DataFrame:
    """Per row: doc_id, k1, k2, dup (its identity), size, source_size, target, copies.

    A null source is a source of its own, a null doc_id or text is allowed. Equal rows
    are numbered by dup and rounded like others. A text without words is taken as often
    as is sure, at no words. Other columns are ignored; runs over the same rows agree.
    """
    identity = [F.col(doc_id).cast("long"), F.col(source).cast("string"), F.col(text)]
    sized = materialise(docs.select(identity[0].alias("doc_id"), identity[1].alias("source"), F.xxhash64(*identity).alias("k1"), F.xxhash64(F.lit(1), *identity).alias("k2"), words(F.col(text)).alias("size")), "sizes")
    source_rows = materialise(targets(sized, weights, max_ratio).withColumn("source_no", F.xxhash64("source", F.col("source").isNull())), "targets")
    scale = source_rows.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("n")).first()
    small = F.broadcast(source_rows) if scale["sources"] <= BROADCAST_ROWS else source_rows
    # equal rows are counted, then numbered
    rows = (sized.groupBy("doc_id", "source", "k1", "k2", "size").agg(F.count(F.lit(1)).alias("equal"))
            .select("doc_id", "source", "k1", "k2", "size", F.explode(F.sequence(F.lit(1), F.col("equal").cast("int"))).alias("dup")))
    rows = rows.join(small.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = materialise(rows.withColumn("sure", F.floor(ratio).cast("int")).withColumn("p", ratio - F.floor(ratio)), "rows")

    buckets = F.ceil(F.col("n") / fan_in)
    level = (rows.filter("p > 0 and size > 0").select("source_no", F.pmod(F.xxhash64(F.lit(SEED + 1), "k1", "k2", "dup"), buckets).alias("bucket"), "k1", "k2", "dup", "size", "p",
                                                     _uniform(F.lit(SEED + 2), F.col("k1"), F.col("k2"), F.col("dup")).alias("u")))
    width, done = math.ceil((scale["n"] or 0) / fan_in), []
    while True:
        rounded = materialise(_round_buckets(level), "rounded")
        done.append(rounded.select(F.explode("done").alias("d")).select("d.*"))
        level = rounded.filter("open is not null").select("source_no", F.floor(F.col("bucket") / fan_in).alias("bucket"), "open.k1", "open.k2", "open.dup", "open.size", "open.p", "open.u")
        if width <= 1:
            break
        width = math.ceil(width / fan_in)
    # the last one of each source goes to the nearer side
    done.append(level.select("k1", "k2", "dup", (F.col("p") >= 0.5).cast("int").alias("extra")))
    extra = reduce(DataFrame.unionByName, done)
    return (rows.join(extra, ["k1", "k2", "dup"], "left")
            .select("doc_id", "k1", "k2", "dup", "size", "source_size", "target", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("copies")))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents, all columns as they were, each as many times as the mix takes it."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = {name: f"c{names.index(name)}" for name in (doc_id, source, text)}
    identity = [F.col(at[doc_id]).cast("long"), F.col(at[source]).cast("string"), F.col(at[text])]
    numbered = (plain.withColumn("k1", F.xxhash64(*identity)).withColumn("k2", F.xxhash64(F.lit(1), *identity))
                .withColumn("dup", F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.xxhash64(*plain.columns)))))
    wanted = copies(docs, doc_id, source, text, **options).filter("copies > 0").select("k1", "k2", "dup", "copies")
    taken = numbered.join(wanted, ["k1", "k2", "dup"])
    return taken.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy").toDF(*names)
