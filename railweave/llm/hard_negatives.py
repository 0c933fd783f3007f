"""Hard negatives by segment summaries.

Vectors are stored with the mean and deviation of each of their segments. The score of
two vectors lies within the segment lengths times the products of their means, plus or
minus the products of their deviations. Segments are refined level by level, coarse
ones being merged from the stored fine ones; a pair whose bounds shut it out of every
list goes no further, and only what is left is scored exactly.

Anchors meet all vectors in blocks of bounded size, keyed by hashes, and each block
returns the best few of each list. A first pass finds every anchor's positives, a second
one the negatives in the score ranges that the positives set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.functions.runtime import materialise

#: Components are multiplied by this and rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, of its positive's, in percent.
LOWEST, HIGHEST = 30, 90
ANCHOR_EVERY = 100
#: Components of the finest segments; each coarser level merges FACTOR segments.
FINEST, FACTOR = 4, 4
#: Vectors and anchors of one block, by their mean; at least LEAST_BLOCKS blocks.
BLOCK, ANCHORS, LEAST_BLOCKS = 2048, 512, 32
#: Larger scaled components count as this, so that scores of up to 1,024 components are whole numbers of 64 bits.
MOST = 1 << 26
#: Pairs whose rows are gathered at once.
GATHER = 1 << 15
#: Below this share of the pairs, bounds and scores are computed pair by pair.
SPARSE = 0.02
_CLEAN = "vec_id long, label long, v array<int>, mean array<float>, dev array<float>"
_FOUND = "anchor_id long, {}other_id long, score long"


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the finest segments of vectors, whose length is a multiple of FINEST."""
    parts = v.reshape(len(v), v.shape[1] // FINEST, FINEST).astype(np.float64)
    return parts.mean(2), parts.std(2)


def merged(mean: np.ndarray, dev: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summaries and lengths of segments that unite FACTOR neighbours."""
    cuts = np.arange(0, len(weight), FACTOR)
    length = np.add.reduceat(weight, cuts)
    center = np.add.reduceat(mean * weight, cuts, axis=1) / length
    square = np.add.reduceat((dev ** 2 + mean ** 2) * weight, cuts, axis=1) / length
    return center, np.sqrt(np.maximum(square - center ** 2, 0)), length


def levels(mean: np.ndarray, dev: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations), each times the root of the segment's length, from one segment to the finest."""
    weight, out = np.full(mean.shape[1], float(FINEST)), []
    while True:
        root = np.sqrt(weight)
        out.append((mean * root, dev * root))
        if len(weight) <= 1:
            return out[::-1]
        mean, dev, weight = merged(mean, dev, weight)


def _pairs(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), a.dtype)
    for k in range(0, len(rows), GATHER):
        out[k:k + GATHER] = np.einsum("ij,ij->i", a[rows[k:k + GATHER]], b[columns[k:k + GATHER]])
    return out


class Block:
    """Anchors against the vectors of one block."""

    def __init__(self, anchors: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...]):
        (self.a, a_mean, a_dev), (self.b, b_mean, b_dev) = anchors, others
        self.a_levels, self.b_levels = levels(a_mean, a_dev), levels(b_mean, b_dev)
        # float32 summaries and sums of doubles are off by less than this share of the norms' product
        norm = lambda level: np.sqrt((level[0] ** 2 + level[1] ** 2).sum(1))
        self.a_slack, self.b_slack = 1e-5 * norm(self.a_levels[-1]) + 1e-3, norm(self.b_levels[-1]) + 1
        self.scored = 0

    def bounds(self, level: int, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Narrow ``low`` and ``high`` of the pairs alive."""
        (am, ad), (bm, bd) = self.a_levels[level], self.b_levels[level]
        if alive.mean() > SPARSE:
            center, width = am @ bm.T, ad @ bd.T + self.a_slack[:, None] * self.b_slack
            np.maximum(low, center - width, out=low, where=alive)
            np.minimum(high, center + width, out=high, where=alive)
            return
        rows, columns = np.nonzero(alive)
        center, width = _pairs(am, bm, rows, columns), _pairs(ad, bd, rows, columns) + self.a_slack[rows] * self.b_slack[columns]
        low[rows, columns] = np.maximum(low[rows, columns], center - width)
        high[rows, columns] = np.minimum(high[rows, columns], center + width)

    def exact(self, alive: np.ndarray) -> np.ndarray:
        """Scores of the pairs alive; the others' are the least number."""
        self.scored += int(alive.sum())
        out = np.full(alive.shape, np.iinfo(np.int64).min)
        # doubles hold sums of up to 53 bits exactly
        small = self.a.shape[1] * float(np.abs(self.a).max(initial=0)) * float(np.abs(self.b).max(initial=0)) < 2 ** 53
        a, b = (self.a.astype(np.float64), self.b.astype(np.float64)) if small else (self.a, self.b)
        if small and alive.mean() > SPARSE:
            return np.where(alive, (a @ b.T).astype(np.int64), out)
        rows, columns = np.nonzero(alive)
        out[rows, columns] = _pairs(a, b, rows, columns)
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def positives_of(block: Block, eligible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores) of each anchor's k best eligible vectors; columns stand in order of their ids."""
    alive, low, high = eligible.copy(), np.where(eligible, -np.inf, -np.inf), np.full(eligible.shape, np.inf)
    for level in range(len(block.a_levels)):
        block.bounds(level, alive, low, high)
        alive &= high >= _kth(low, k)[:, None]
    return _best(block.exact(alive), alive, k)


def _best(scores: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(np.where(alive, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
    taken = np.take_along_axis(alive, order, 1)
    rows = np.nonzero(taken)[0]
    columns = order[taken]
    return rows, columns, scores[rows, columns]


def negatives_of(block: Block, eligible: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(rows, range numbers, columns, scores): the k best eligible vectors in each of an anchor's ranges [least, most]."""
    alive, low, high = eligible.copy(), np.full(eligible.shape, -np.inf), np.full(eligible.shape, np.inf)
    for level in range(len(block.a_levels)):
        block.bounds(level, alive, low, high)
        wanted = np.zeros_like(alive)
        for r in range(least.shape[1]):
            floor, top = least[:, r, None], most[:, r, None]
            sure = np.where(alive & (high <= top) & (low >= floor), low, -np.inf)
            wanted |= (low <= top) & (high >= np.maximum(floor, _kth(sure, k)[:, None]))
        alive &= wanted
    scores = block.exact(alive)
    order = np.argsort(np.where(alive, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")
    ranked, n = np.take_along_axis(scores, order, 1), alive.sum(1)
    out = []
    for r in range(least.shape[1]):
        above = (alive & (scores > most[:, r, None])).sum(1)
        at = above[:, None] + np.arange(k)
        inside = at < n[:, None]
        at = np.minimum(at, max(scores.shape[1] - 1, 0))
        inside &= np.take_along_axis(ranked, at, 1) >= least[:, r, None]
        rows = np.nonzero(inside)[0]
        out.append((rows, np.full(len(rows), r), np.take_along_axis(order, at, 1)[inside], np.take_along_axis(ranked, at, 1)[inside]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _arrays(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    shape = (table.num_rows, -1)
    return flat("v").reshape(table.num_rows, width).astype(np.int64), *(flat(c).reshape(shape if table.num_rows else (0, width // FINEST)).astype(np.float64) for c in ("mean", "dev"))


def indexed(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", relabel: Column | None = None) -> tuple[DataFrame, int]:
    """(vec_id, label, v, mean, dev) of the rows that take part, written once, and the length of v.

    ``relabel`` replaces the label of rows that have one. A null id, label, vector or
    component, or one that is not finite, leaves the row out. Of rows that repeat an id,
    the one with the least label, then the least vector, takes part. Shorter vectors are
    filled with zeros, components beyond MOST count as MOST.
    """
    wide = F.transform(F.col(embedding), lambda x: x.cast("double"))
    whole = F.col(embedding).isNotNull() & F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = F.transform(wide, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * SCALE))).cast("int"))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & whole).select(
        F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if relabel is None else relabel).cast("long").alias("label"), scaled.alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    width = vectors.agg(F.max(F.size(embedding))).first()[0] or 1
    width = FINEST * -(-max(width, 1) // FINEST)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))

    def summarised(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            mean, dev = summaries(v)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), width // FINEST).cast(pa.list_(pa.float32())) for x in (mean, dev)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], ["vec_id", "label", "v", "mean", "dev"])

    return materialise(rows.mapInArrow(summarised, _CLEAN), "vectors"), width


def _cells(anchors: DataFrame, others: DataFrame, n_anchors: int, n_others: int, same_label: bool):
    """Both sides keyed by cell: every anchor meets every vector (of its label) in exactly one cell."""
    across, down = max(1, -(-n_anchors // ANCHORS)), max(LEAST_BLOCKS, -(-n_others // BLOCK))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*(["label"] if same_label else []), "across", "down"]
    # both sides may come from one table, so the columns get identities of their own
    anchors, others = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (anchors, others))
    left = anchors.withColumn("across", place(across)).withColumn("down", every(down))
    right = others.withColumn("down", place(down)).withColumn("across", every(across))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("vec_id")


def positives(index: DataFrame, width: int, anchors: DataFrame, n_anchors: int, n: int, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, rank, positive_id, positive_score): each anchor's k best other rows of its label."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _sorted(left), _sorted(right)
        ids, others = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        rows, columns, scores = positives_of(Block(_arrays(left, width), _arrays(right, width)), ids[:, None] != others, k) if len(ids) and len(others) else (np.empty(0, int),) * 3
        return pa.table({"anchor_id": ids[rows], "other_id": others[columns], "score": scores.astype(np.int64)}, schema=pa.schema([("anchor_id", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())]))

    found = _cells(anchors, index, n_anchors, n, True).applyInArrow(run, _FOUND.format(""))
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("anchor_id", "rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))


def mine(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", relabel: Column | None = None, every: int = ANCHOR_EVERY,
         n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """Per anchor, positive and rank: negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides. Scores are whole numbers; higher
    ones come first, ties by smaller id. A positive's negatives are the best rows of
    other labels with a score of ``lowest`` to ``highest`` percent of the positive's.
    ``indexed`` states which rows take part. Zero vectors score 0; an empty table or one
    without anchors gives no row. Other columns are ignored.
    """
    index, width = indexed(vectors, vec_id, label, embedding, relabel)
    n = index.count()
    chosen = index.filter(F.col("vec_id") % every == 0)
    n_anchors = chosen.count()
    found = materialise(positives(index, width, chosen, n_anchors, n, n_positives), "positives")
    # 100 * negative <= highest * positive, 100 * negative >= lowest * positive, in whole numbers
    ranges = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("ranked"))  # n_positives at most
    asking = chosen.join(ranges.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("scores", F.transform("ranked", lambda x: x["positive_score"])).drop("ranked")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _sorted(left), _sorted(right)
        ids, others = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        out = (np.empty(0, np.int64),) * 4
        if len(ids) and len(others):
            listed = left.column("scores").to_pylist()
            least, most = np.full((len(ids), n_positives), 1), np.full((len(ids), n_positives), 0)  # empty ranges
            for i, scores in enumerate(listed):
                least[i, :len(scores)] = [-(-lowest * s // 100) for s in scores]
                most[i, :len(scores)] = [highest * s // 100 for s in scores]
            eligible = left.column("label").to_numpy()[:, None] != right.column("label").to_numpy()
            out = negatives_of(Block(_arrays(left, width), _arrays(right, width)), eligible, least, most, n_negatives)
        rows, number, columns, scores = out
        return pa.table({"anchor_id": ids[rows], "number": number.astype(np.int32) + 1, "other_id": others[columns], "score": scores.astype(np.int64)},
                        schema=pa.schema([("anchor_id", pa.int64()), ("number", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())]))

    hits = _cells(asking, index, n_anchors, n, False).applyInArrow(run, _FOUND.format("number int, "))
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "number").orderBy(F.desc("score"), "other_id"))).filter(F.col("rank") <= n_negatives)
    of = found.select("anchor_id", F.col("rank").alias("number"), "positive_id", "positive_score")
    return best.join(of, ["anchor_id", "number"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
