"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots.

Every level is an equijoin of its nodes with the nodes at their computed sibling
indices: index XOR 1 where runs hold two nodes, the other slots of the run elsewhere.
Rows in slot zero then emit the parents. Joins are keyed by (group, index), so a group
that holds most rows is spread like any other. Proofs go down the same way: a node's
path is its siblings, followed by its parent's path.

Order within a group is a range-partitioned sort whose partitions are numbered by their
counts, so no group is ever sorted or numbered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.functions.runtime import materialise

#: Nodes of a run.
ARITY = 2
#: Columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels whose paths are joined in one job; longer chains are cut by a written table.
CHAIN = 5
_PATH = "array<struct<before: array<binary>, after: array<binary>>>"


def digest(*hexes: Column) -> Column:
    """SHA-256 of digests as hex text; nulls add nothing."""
    return F.unhex(F.sha2(F.concat_ws("", *hexes), 256))


def hex_text(hashed: Column) -> Column:
    return F.lower(F.hex(hashed))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in columns)), 256))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with a column ``g``) with their index in g by ``order`` and the group's size n.

    Rows equal in ``order`` are spread over ranges by their place in the input, so they
    may be the whole table.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("g"), *order, F.col("tie")]
    placed = materialise(tied.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    local = placed.withColumn("at", F.row_number().over(Window.partitionBy("range", "g").orderBy(*order, "tie")) - 1)
    counts = placed.groupBy("g", "range").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("g")  # a row for each range that holds the group
    offsets = counts.select("g", "range", (F.sum("rows").over(whole.orderBy("range")) - F.col("rows")).alias("offset"), F.sum("rows").over(whole).alias("n"))
    return local.join(offsets, ["g", "range"]).withColumn("idx", (F.col("offset") + F.col("at")).cast("long")).drop("range", "offset", "at", "tie")


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Nodes (g, idx, n, hash) with ``before`` and ``after``: the other slots of their runs, null where there is none."""
    slot = F.pmod(F.col("idx"), F.lit(arity))
    out = nodes
    if arity == 2:
        other = nodes.select("g", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), F.col("hash").alias("sib"))
        joined = nodes.join(other, ["g", "idx"], "left")
        before, after = [F.when(slot == 1, F.col("sib"))], [F.when(slot == 0, F.col("sib"))]
    else:
        joined = nodes
        for k in range(1, arity):  # the slot k places on in the run, round to its start
            shifted = F.col("idx") - slot + F.pmod(slot - k, F.lit(arity))
            joined = joined.join(nodes.select("g", shifted.alias("idx"), F.col("hash").alias(f"sib{k}")), ["g", "idx"], "left")
        # slot + k beyond the run has come round to the slots before
        before = [F.when(slot + k >= arity, F.col(f"sib{k}")) for k in range(1, arity)]
        after = [F.when(slot + k < arity, F.col(f"sib{k}")) for k in range(1, arity)]
    found = lambda side: F.filter(F.array(*side), lambda x: x.isNotNull())
    return joined.select("g", "idx", "n", "hash", found(before).alias("before"), found(after).alias("after"))


def folded(own: Column, path: Column) -> Column:
    """The root that a hash and its path lead to."""
    texts = lambda side: F.array_join(F.transform(side, hex_text), "")
    return F.aggregate(path, own, lambda acc, step: F.unhex(F.sha2(F.concat(texts(step["before"]), hex_text(acc), texts(step["after"])), 256)))


def grow(nodes: DataFrame, most: int, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """(levels with siblings, leaves first; (g, hash, depth) of every group's root) of nodes (g, idx, n, hash)."""
    lone = lambda level: nodes.filter("n = 1").select("g", "hash", F.lit(level).alias("depth"))
    levels, roots = [], [lone(0)]
    while most > 1:
        level = materialise(with_siblings(nodes.filter("n > 1"), arity), "level")
        levels.append(level)
        siblings = F.array_join(F.transform("after", hex_text), "")
        parent = [F.floor(F.col(c) / arity).cast("long").alias(c) if c == "idx" else F.ceil(F.col(c) / arity).cast("long").alias(c) for c in ("idx", "n")]
        nodes = level.filter(F.pmod(F.col("idx"), F.lit(arity)) == 0).select("g", *parent, digest(hex_text(F.col("hash")), siblings).alias("hash"))
        roots.append(lone(len(levels)))
        most = -(-most // arity)
    return levels, materialise(reduce(DataFrame.unionByName, roots), "roots")


def descend(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """Paths of all leaves: g, idx, path, and the columns that ``tops`` hands down.

    ``tops``: g, depth, path (from the group's root on) and any other columns.
    """
    kept = [c for c in tops.columns if c not in ("g", "path", "depth")]
    top = lambda depth: tops.filter(F.col("depth") == depth).select("g", F.lit(0).cast("long").alias("idx"), "path", *kept)
    paths = top(len(levels))
    for depth in range(len(levels) - 1, -1, -1):
        own = levels[depth].select("g", "idx", F.floor(F.col("idx") / arity).cast("long").alias("up"), F.array(F.struct("before", "after")).alias("step"))
        grown = own.join(paths.withColumnRenamed("idx", "up"), ["g", "up"]).select("g", "idx", F.concat("step", "path").alias("path"), *kept)
        paths = top(depth).unionByName(grown)
        if (len(levels) - depth) % CHAIN == 0 and depth:
            paths = materialise(paths, "paths")
    return paths


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", claimed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """Per row: key, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    ``claimed`` is the leaf (binary) that a possibly altered row shows, null where it
    shows its own; it is folded with the original siblings, and ``verified`` tells whether
    that gives the root. Within a group leaves ascend by key, null first, then by leaf;
    groups are ordered bytewise, null first. Null, empty and long values are hashed by
    ``field``; rows that repeat are leaves of their own; a lone leaf is its group's root
    and a lone group's root the root. Other columns are ignored; an empty table gives no
    row. ``path`` lists the siblings of each level, before and after, up to the root.
    """
    g = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(g.alias("g"), F.col(key).alias("key"), leaf_hash([F.col(c) for c in fields]).alias("hash"),
                         (F.lit(None).cast("binary") if claimed is None else claimed).alias("claimed"))
    nodes = materialise(numbered(leaves, [F.col("key").asc_nulls_first(), F.col("hash")]), "leaves")
    levels, subroots = grow(nodes.select("g", "idx", "n", "hash"), nodes.agg(F.max("n")).first()[0] or 0, arity)
    groups = materialise(numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "hash", "depth"), [F.col("group")]), "groups")
    upper, root = grow(groups.select("g", "idx", "n", "hash"), groups.agg(F.max("n")).first()[0] or 0, arity)
    above = descend(upper, root.select("g", "depth", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root")), arity)
    tops = materialise(groups.join(above, ["g", "idx"]).select(F.col("group").alias("g"), "depth", "path", "root", F.col("hash").alias("subroot")), "tops")
    proven = nodes.join(descend(levels, tops, arity), ["g", "idx"]).withColumn("folded", folded(F.coalesce("claimed", "hash"), F.col("path")))
    texts = F.flatten(F.transform("path", lambda step: F.transform(F.concat(step["before"], step["after"]), hex_text)))
    return proven.select(F.col("key").alias(key), hex_text(F.col("hash")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"), "path",
                         F.sha2(F.array_join(texts, ""), 256).alias("proof_sha256"), hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def check_column(documents_n_chars: str = "n_chars", key: str = "doc_id") -> Column:
    """Leaves after tampering with the rows whose key's CRC-32 is a multiple of 7: one more in ``n_chars``."""
    altered = [F.try_add(F.col(c), F.lit(1)) if c == documents_n_chars else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0, leaf_hash(altered))
