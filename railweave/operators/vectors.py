"""Embeddings and nearest documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from railweave import fixed_values as fv

#: Rows of a block, at most, and numbers in its vectors, at most.
BLOCK_QUESTIONS, BLOCK_DOCUMENTS, BLOCK_NUMBERS = 65536, 131072, 1 << 24
MIN_BLOCK_DOCUMENTS = 1024
#: Questions and documents of a block that are multiplied at once, and documents at least: their products stay in a core's cache.
TILE_QUESTIONS, TILE_DOCUMENTS, LEAST_TILE = 1024, 256, 32
#: Tiles after which the best so far are settled anew, at most.
LAST_STEP = 32
#: Pairs of blocks that are dealt evenly, for each task.
EVEN_ROUNDS = 16


def embed_documents(df: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "content",
                    out: str = "embedding") -> DataFrame:
    """Adds a vector per row with any model.

    ``model`` is called once per task and returns a function from a list of texts
    to a matrix; it sees one Arrow batch at a time.
    """
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for pdf in batches:
            yield pdf.assign(**{out: list(np.asarray(encode(pdf[text].tolist()), dtype=np.float32))})

    return df.mapInPandas(run, schema)


def _buckets(text: str, dim: int):
    """Bucket of every word; null for null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


def fit_term_weights(documents: DataFrame, text: str = "content", dim: int = 64) -> DataFrame:
    """(bucket, documents, weight) of all ``dim`` buckets, counted over all documents.

    The weight is the logarithm of (documents + 1) / (documents with the bucket + 1).
    Counts are summed where the texts are read, so ``dim`` rows leave a task. Null texts
    count as documents without words. Stored like any table and given to ``hashed_embedding``.
    """
    seen = documents.select(F.explode(F.array_distinct(_buckets(text, dim))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("documents"))
    total = documents.agg(F.count(F.lit(1))).scalar()
    every = documents.sparkSession.range(dim).select(F.col("id").cast("int").alias("bucket"))
    n = F.coalesce("documents", F.lit(0))
    return every.join(seen, "bucket", "left").select("bucket", n.alias("documents"), F.log((total + 1) / (n + 1)).alias("weight"))


def hashed_embedding(df: DataFrame, text: str = "content", out: str = "embedding", dim: int = 64, weights: DataFrame | None = None) -> DataFrame:
    """Offline default: hashed word counts of unit length, needs no model.

    With ``weights`` (see ``fit_term_weights``) a count is multiplied by its bucket's
    weight. Words are hashed in the JVM; a task counts the buckets of a whole Arrow batch
    at once. A null text has a null vector, a text without words a zero one.
    """
    factor = np.ones(dim)
    if weights is not None:
        for row in weights.select("bucket", "weight").limit(dim).collect():  # a row for each bucket
            factor[row["bucket"]] = row["weight"]

    @F.arrow_udf("array<double>")
    def unit_counts(rows: pa.Array) -> pa.Array:
        n = len(rows)
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(n) * dim, sizes) + rows.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(place, minlength=n * dim).reshape(n, dim) * factor
        counts = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
        offsets = pa.array(np.arange(n + 1) * dim, pa.int32(), mask=np.append(rows.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()))

    return df.withColumn(out, unit_counts(_buckets(text, dim)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    if pc.count_distinct(pc.list_value_length(rows)).as_py() > 1:
        raise ValueError("vectors differ in length")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _best(a: np.ndarray, b: np.ndarray, k: int, min_score: float, l2: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the best ``k`` rows of ``b`` for each row of ``a``; the earlier row wins ties.

    Products in single precision pass over what cannot enter: less than the k-th best, of
    the tiles' best ones or so far, by more than their rounding error. The others are
    scored in double precision.
    """
    # inner products that rank as the metric does; the distance becomes one by two more components
    half = lambda m: (m * m).sum(1) / np.sqrt(2)
    one = lambda m: np.ones((len(m), 1))
    wide_a = np.hstack([np.sqrt(2) * a, 1 - half(a)[:, None], one(a)]) if l2 else a
    wide_b = np.hstack([b, one(b), -half(b)[:, None]]) if l2 else b
    fit = lambda m: np.where(np.isfinite(m).all(1)[:, None], m, 0.0)
    clean_a, clean_b = fit(wide_a), fit(wide_b)
    norm_a, norm_b = np.linalg.norm(clean_a, axis=1), np.linalg.norm(clean_b, axis=1)
    large = norm_a.max(initial=0) * norm_b.max(initial=0) > 1e30  # beyond single precision
    with np.errstate(over="ignore"):
        a32, b32 = clean_a.astype(np.float32), np.ascontiguousarray(clean_b.astype(np.float32).T)
    usable = np.isfinite(wide_b).all(1)
    tile = min(TILE_DOCUMENTS, max(LEAST_TILE, len(b) // (4 * k)))
    starts = range(0, len(b), tile)
    whole = [usable[first:first + tile].all() for first in starts]
    room = np.empty(TILE_QUESTIONS * tile, np.float32)
    error = (a.shape[1] + 10) * 2.0 ** -23
    out = []
    for low in range(0, len(a), TILE_QUESTIONS):
        rows_a = slice(low, min(len(a), low + TILE_QUESTIONS))
        n = rows_a.stop - low
        # the best guess of each tile: the k-th best of these is reached by k rows, so what is below it cannot enter
        tops, reached = np.full((n, len(starts)), np.inf, np.float32), np.full(n, -np.inf)
        if not large:
            for i, first in enumerate(starts):
                m = min(tile, len(b) - first)
                np.matmul(a32[rows_a], b32[:, first:first + m], out=room[:n * m].reshape(n, m)).max(axis=1, out=tops[:, i])
            sure = tops[:, whole]
            if sure.shape[1] >= k:
                reached = np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k] - error * norm_a[rows_a] * norm_b.max() - 0.00011  # rows of equal rounded scores
            tops[:, np.logical_not(whole)] = np.inf
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        kth = np.full(n, -np.inf)
        at, step = 0, 1
        while at < len(starts):
            end = min(len(starts), at + step)
            floor = np.maximum(np.maximum(min_score, reached), kth + 0.00004) - error * norm_a[rows_a] * norm_b[at * tile:end * tile].max(initial=0)
            if not large:
                floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
            rows, cols, scores = [], [], []
            for i in range(at, end):
                first, m = starts[i], min(tile, len(b) - starts[i])
                cols_b = slice(first, first + m)
                if large:
                    row, col = (x.ravel() for x in np.indices((n, m)))
                else:
                    near = np.flatnonzero(tops[:, i] >= floor)
                    if not len(near):
                        continue
                    row, col = np.divmod(np.flatnonzero(a32[low + near] @ b32[:, cols_b] >= floor[near, None]), m)
                    row = near[row]
                if 8 * len(row) > n * m:
                    s = (a[rows_a] @ b[cols_b].T)[row, col]
                else:
                    s = np.einsum("ij,ij->i", a[low + row], b[first + col])
                if l2:
                    s = 1 - ((a[rows_a] ** 2).sum(1)[row] + (b[cols_b] ** 2).sum(1)[col] - 2 * s) / np.sqrt(2)
                # the cut-off applies to the exact score, the order to the rounded one: equal rounded scores go by row
                r = np.round(s, 4)
                new = np.flatnonzero((s >= min_score) & np.isfinite(s) & (r > kth[row]))
                rows.append(row[new])
                cols.append(first + col[new])
                scores.append(r[new])
            if sum(map(len, rows)):
                row, col, r = (np.concatenate([x, *y]) for x, y in zip(kept, (rows, cols, scores), strict=True))
                order = np.lexsort((col, -r, row))
                row, col, r = row[order], col[order], r[order]
                first = np.searchsorted(row, np.arange(n))
                within = np.arange(len(row)) - first[row] < k
                kept = (row[within], col[within], r[within])
                last = np.searchsorted(kept[0], np.arange(n)) + k - 1
                full = np.bincount(kept[0], minlength=n) >= k
                kth[full] = kept[2][last[full]]
            at, step = end, min(LAST_STEP, 2 * step)
        out.append((low + kept[0], kept[1], kept[2]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _document_blocks(n, q_blocks, size, tasks: int):
    """Blocks of ``n`` documents: each holds ``size`` at most, and all pairs with the question blocks
    keep the tasks busy. Every block is sent all questions, so there are no more than that."""
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(n / size))
    return F.greatest(blocks(size), F.least(F.ceil(F.lit(2 * tasks) / q_blocks), blocks(F.lit(MIN_BLOCK_DOCUMENTS)))).cast("int")


def even_keys(count: int, parts: int) -> list[int]:
    """``count`` numbers of which Spark's hash deals the first to the first of ``parts`` partitions, the next to the next and so on."""
    word = 0xFFFFFFFF
    turn = lambda x, n: (x << n | x >> (32 - n)) & word

    def part(i: int) -> int:
        h = 42 ^ turn(i * 0xCC9E2D51 & word, 15) * 0x1B873593 & word
        h = (turn(h, 13) * 5 + 0xE6546B64) & word ^ 4
        h = (h ^ h >> 16) * 0x85EBCA6B & word
        h = (h ^ h >> 13) * 0xC2B2AE35 & word
        h ^= h >> 16
        return (h - (h >> 31 << 32)) % parts

    found, rounds = [[] for _ in range(parts)], -(-count // parts)
    missing, i = parts * rounds, 0
    while missing:
        mine = found[part(i)]
        if len(mine) < rounds:
            mine.append(i)
            missing -= 1
        i += 1
    return [found[p % parts][p // parts] for p in range(count)]


def vector_topk(questions: DataFrame, documents: DataFrame, k: int = fv.PER_COLLECTION_K, min_score: float = fv.MIN_RELEVANCE,
                metric: str = "cosine", question_id: str = "question_id", doc_id: str = "doc_id",
                block_questions: int = BLOCK_QUESTIONS, block_documents: int = BLOCK_DOCUMENTS, wanted: str | None = None) -> DataFrame:
    """Nearest ``k`` documents per (question, collection) with a score of at least ``min_score``.

    Both sides carry ``embedding``; ``collection`` is a document column. Questions
    and documents are cut into blocks of bounded size and each pair of blocks
    returns its best ``k`` per question and collection (``_best``), so neither side is
    collected or broadcast and no pair of rows is formed. Blocks are as large as a task can
    hold, because each side is sent once for every block of the other: up to
    ``block_questions`` questions, documents are shuffled once. Documents are cut further
    only where there would be too few pairs of blocks for all tasks. Tasks get equally many
    pairs of blocks, as these take long and are few. The blocks' winners are merged by a
    windowed limit. Exact; ties by document id. Rows without a vector, an id of the
    question or a collection take no part.

    ``wanted`` names a question column with the collections that a question asks; the
    others are not scored for it. Null asks all.
    ``metric='l2_relevance'`` turns squared distance into ``1 - d/sqrt(2)``.
    """
    more = [] if wanted is None else [F.col(wanted).alias("wanted")]
    q = questions.where(F.col("embedding").isNotNull()).select(F.col(question_id).alias("question_id"), F.col("embedding").cast("array<double>").alias("v"), *more).where(F.col("question_id").isNotNull())
    d = documents.where(F.col("embedding").isNotNull() & F.col("collection").isNotNull()).select("collection", F.col(doc_id).alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = questions.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).select(F.struct("n", "width"))
    sizes = counted.scalar()
    most = lambda size: F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest(F.lit(1), sizes["width"]))))
    q_blocks = F.greatest(F.lit(1), F.ceil(sizes["n"] / most(block_questions))).cast("int")
    d_blocks = _document_blocks(documents.agg(F.count(F.lit(1))).scalar(), q_blocks, most(block_documents), tasks)
    q = (q.withColumn("qb", F.pmod(F.xxhash64("question_id"), q_blocks).cast("int"))
         .withColumn("db", F.explode(F.sequence(F.lit(0), d_blocks - 1))))
    d = (d.withColumn("db", F.pmod(F.xxhash64("collection", "doc_id"), d_blocks).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), q_blocks - 1))))
    # Spark's hash deals the keys of the first pairs evenly; where there are more, chance does. Blocks of the same
    # questions meet in a task, which then sends their best only
    keys = even_keys(EVEN_ROUNDS * tasks, tasks)
    place = F.col("db").cast("bigint") * q_blocks + F.col("qb")
    pair = F.coalesce(F.get(F.split(F.lit(",".join(map(str, keys))), ",").cast("array<int>"), place.cast("int")), (place + max(keys) + 1).cast("int")).alias("pair")
    q, d = (side.select(*(c for c in side.columns if c not in ("qb", "db")), pair).repartition(tasks, "pair") for side in (q, d))
    q_type, d_type = q.schema["question_id"].dataType.simpleString(), d.schema["doc_id"].dataType.simpleString()
    c_type = d.schema["collection"].dataType.simpleString()

    def block_topk(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("question_id")
        right = right.sort_by([("collection", "ascending"), ("doc_id", "ascending")])
        parts = [(ids.slice(0, 0), right.column("collection").slice(0, 0), right.column("doc_id").slice(0, 0), pa.chunked_array([], pa.float64()))]
        if len(left) and len(right):
            a, b = _matrix(left.column("v")), _matrix(right.column("v"))
            codes = right.column("collection").combine_chunks().dictionary_encode().indices.to_numpy()
            starts = [*np.flatnonzero(np.diff(codes, prepend=-1)), len(right)]
            asking = [None if x is None else set(x) for x in left.column("wanted").to_pylist()] if wanted is not None else None
            for start, end in zip(starts, starts[1:]):
                some = np.arange(len(a))
                if asking is not None:
                    name = right.column("collection")[start].as_py()
                    some = np.flatnonzero([x is None or name in x for x in asking])
                if not len(some):
                    continue
                rows, cols, scores = _best(a[some] if len(some) < len(a) else a, b[start:end], k, min_score, metric == "l2_relevance")
                found = pa.array(start + cols)
                parts.append((ids.take(pa.array(some[rows])), right.column("collection").take(found), right.column("doc_id").take(found), pa.chunked_array([pa.array(scores)])))
        columns = [pa.chunked_array([c for part in parts for c in part[i].chunks], parts[0][i].type) for i in range(4)]
        return pa.table(columns, ["question_id", "collection", "doc_id", "score"])

    hits = (q.groupBy("pair").cogroup(d.groupBy("pair"))
            .applyInArrow(block_topk, f"question_id {q_type}, collection {c_type}, doc_id {d_type}, score double"))
    w = W.partitionBy("question_id", "collection").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_topk(hits: DataFrame, k: int = fv.TOP_K) -> DataFrame:
    """Per-collection hits of a question merged to its best ``k``, ranks from zero."""
    w = W.partitionBy("question_id").orderBy(F.desc("score"), "collection", "doc_id")
    return (hits.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank") - 1))
