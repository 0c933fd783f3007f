"""Vector index: coarse cells, product-quantised residuals, inverted lists, exact re-rank.

The model (cell centres of each collection and code books) is fitted on a bounded
sample; every document is indexed. Lists are stored by cell, in parts of bounded size: a
row holds the ids, codes and full vectors of a part. A search joins questions with the
nearest cells of every collection, scores the codes of those lists only, and reads full
vectors for the survivors' parts alone. Questions of a cell are packed into blocks, so a
list is sent once for many questions and what is shuffled does not grow with their number.
The lists of the very nearest cells are scored first: they give each question a score that
its survivors reach, so the parts of all other lists return next to nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions.runtime import materialise

#: Vectors from which the model is fitted, at most, and collections that have cells of their own.
SAMPLE, COLLECTIONS = 60_000, 64
#: Cells of a collection, at most; subspaces, centres in each, rounds of the fit.
CELLS, SUBSPACES, CENTRES, ROUNDS = 256, 16, 256, 10
#: Cells of each collection that a question looks into, and candidates re-ranked per question and collection.
PROBES, SURVIVORS = 96, 128
#: Nearest cells of each collection that are scored first: so many, and on until they hold so many times the survivors.
NEAR, NEAR_SURVIVORS = 4, 4
#: Scores that a part reports of its best ones then, at equal steps of rank.
LEVELS = 16
#: Documents in a part of a list, and questions in a block, by their mean; questions in a block of the exact scores.
PART, BLOCK, EXACT_BLOCK = 4096, 1024, 8192
#: Questions and codes that are multiplied at once: their products stay in a core's cache.
TILE_QUESTIONS, TILE_CODES = 512, 512
#: Folders over which the cells are dealt.
SHARDS = 64
SEED = 7


@dataclass
class IndexModel:
    """Cell centres (cells x dim), the collection of each, and per subspace the centres of the residuals.

    Null stands for collections that have no cells of their own; they share its cells.
    """

    owners: list[str | None]
    cells: np.ndarray
    books: np.ndarray

    def __post_init__(self):
        self.of = {name: np.flatnonzero([x == name for x in self.owners]) for name in dict.fromkeys(self.owners)}

    def cell(self, vectors: np.ndarray, collections: list[str | None]) -> np.ndarray:
        """The nearest cell of each vector's collection."""
        out, names = np.zeros(len(vectors), np.int64), np.array([x if x in self.of else None for x in collections], object)
        for name, cells in self.of.items():
            rows = np.flatnonzero(names == name)
            centres = self.cells[cells]
            out[rows] = cells[((centres ** 2).sum(1) - 2 * vectors[rows] @ centres.T).argmin(1)]
        return out

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n cells of each collection whose centres have the largest products with each vector."""
        return np.concatenate(list(self.nearest(vectors, n)), axis=1)

    def nearest(self, vectors: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """The same for one collection after the other, the nearest cell first."""
        for cells in self.of.values():
            product = vectors @ self.cells[cells].T
            few = min(n, len(cells))
            some = np.argpartition(-product, few - 1, axis=1)[:, :few]
            yield cells[np.take_along_axis(some, np.argsort(-np.take_along_axis(product, some, 1), axis=1, kind="stable"), 1)]

    def encode(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """One byte per subspace."""
        m, k, width = self.books.shape
        rest = (vectors - self.cells[cell]).reshape(len(vectors), m, width)
        out = np.empty((len(vectors), m), np.uint8)
        for s in range(m):
            out[:, s] = ((self.books[s] ** 2).sum(1) - 2 * rest[:, s] @ self.books[s].T).argmin(1)
        return out

    def decode(self, codes: np.ndarray, cell: int) -> np.ndarray:
        m = self.books.shape[0]
        return self.books[np.arange(m), codes].reshape(len(codes), -1) + self.cells[cell]


def _lloyd(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """k centres by Lloyd's rounds; a centre that loses its points takes the worst-placed one."""
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].astype(np.float64).copy()
    for _ in range(rounds):
        distance = (centres ** 2).sum(1) - 2 * points @ centres.T
        near = distance.argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            worst = np.argsort(-(distance[np.arange(len(points)), near] + (points ** 2).sum(1)), kind="stable")
            empty = np.flatnonzero(~full)
            centres[empty] = points[worst[np.arange(len(empty)) % len(points)]]
    return centres


def fit_index(documents: DataFrame, cells: int = CELLS, subspaces: int = SUBSPACES, sample: int = SAMPLE, doc_id: str = "doc_id") -> IndexModel:
    """Model from at most ``sample`` vectors, dealt evenly over collections, drawn by the hash of id and vector.

    A collection with few vectors has fewer cells; beyond COLLECTIONS the smallest ones
    share the cells of null. Null vectors are left out. The length of a vector must be a
    multiple of ``subspaces``.
    """
    place = F.pmod(F.xxhash64(doc_id, "embedding"), F.lit(1 << 30))
    known = documents.where(F.col("embedding").isNotNull()).select("collection", F.col("embedding").cast("array<double>").alias("v"), place.alias("place"))
    # at most COLLECTIONS rows
    counts = known.where(F.col("collection").isNotNull()).groupBy("collection").count().orderBy(F.desc("count"), "collection").limit(COLLECTIONS).collect()
    share, names = sample // (len(counts) + 1), {r["collection"]: r["count"] for r in counts}
    kept = F.create_map(*(F.lit(x) for name, n in names.items() for x in (name, int((1 << 30) * min(1.0, 0.9 * share / n))))) if names else F.create_map(F.lit(""), F.lit(0))
    own = known.where(F.col("place") < F.get(F.map_values(kept), F.array_position(F.map_keys(kept), F.col("collection")).cast("int") - 1))
    rest = known.where(F.col("collection").isNull() | ~F.col("collection").isin(*names)).withColumn("collection", F.lit(None).cast("string"))
    rest = rest.where(F.col("place") < int((1 << 30) * min(1.0, 0.9 * share / max(1, rest.count())))).limit(share)
    rows = own.limit(sample).unionByName(rest).toArrow()
    found, vectors = rows.column("collection").to_pylist(), rows.column("v").to_pylist()
    if not vectors:
        return IndexModel([None], np.zeros((1, 0)), np.zeros((subspaces, 1, 0)))
    order = sorted(range(len(found)), key=lambda i: (found[i] is not None, found[i] or "", vectors[i]))
    points, found = np.array([vectors[i] for i in order]), np.array([found[i] for i in order], object)
    rng, owners, centres = np.random.default_rng(SEED), [], []
    for name in [None, *sorted(names)]:
        mine = points[found == name]
        centres.append(_lloyd(mine, max(1, min(cells, len(mine) // 16)), rng) if len(mine) else points.mean(0, keepdims=True))
        owners += [name] * len(centres[-1])
    model = IndexModel(owners, np.concatenate(centres), np.zeros((subspaces, 0, points.shape[1] // subspaces)))
    few = rng.permutation(len(points))[:20_000]
    left = (points - model.cells[model.cell(points, list(found))])[few].reshape(len(few), subspaces, -1)
    model.books = np.stack([_lloyd(left[:, s], CENTRES, rng) for s in range(subspaces)])
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _assigned(documents: DataFrame, model: IndexModel, doc_id: str) -> DataFrame:
    """(collection, doc_id, v, cell) of the documents that have a vector."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # cells and code books, of the model's fixed size
    rows = documents.where(F.col("embedding").isNotNull()).select("collection", F.col(doc_id).alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.cell(_matrix(batch.column("v")), batch.column("collection").to_pylist()) if len(batch) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(assign, f"collection {types['collection']}, doc_id {types['doc_id']}, v array<double>, cell int")


def _write(placed: DataFrame, model: IndexModel, path: str, part: int) -> None:
    """Packs documents into parts and replaces the shards that they fall into."""
    shared = placed.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in placed.schema}
    sizes = placed.groupBy("collection", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("parts"))  # a row for each cell
    sizes = sizes.select(F.col("collection").alias("c"), F.col("cell").alias("l"), "parts")
    placed = placed.join(sizes, F.col("collection").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("l"))).drop("c", "l").withColumn("part", F.pmod(F.xxhash64("doc_id", "v"), "parts").cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        vectors = _matrix(group.column("v").combine_chunks())
        cell = group.column("cell")[0].as_py()
        codes = shared.value.encode(vectors, np.full(len(vectors), cell))
        ids = pa.array([group.column("doc_id").to_pylist()], pa.list_(group.schema.field("doc_id").type))
        return pa.table([group.column("collection").slice(0, 1), group.column("cell").slice(0, 1), group.column("part").slice(0, 1), ids,
                         pa.array([codes.tobytes()]), pa.array([vectors.astype(np.float64).tobytes()])], names=["collection", "cell", "part", "ids", "codes", "vectors"])

    schema = f"collection {types['collection']}, cell int, part int, ids array<{types['doc_id']}>, codes binary, vectors binary"
    packed = placed.groupBy("collection", "cell", "part").applyInArrow(pack, schema).withColumn("shard", F.pmod("cell", F.lit(SHARDS)))
    packed.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def build_index(documents: DataFrame, model: IndexModel, path: str, part: int = PART, doc_id: str = "doc_id") -> None:
    """Writes rows (collection, cell, part, ids, codes, vectors) to ``path``, an empty or new folder.

    Every document with a vector is in exactly one part; parts of a cell hold about
    ``part`` documents however full the cell is. Codes and vectors are columns of their
    own, so a search that reads codes does not read vectors. Cells are dealt over SHARDS
    folders, which an update replaces one by one.
    """
    _write(_assigned(documents, model, doc_id), model, path, part)


def update_index(changes: DataFrame, model: IndexModel, path: str, part: int = PART, doc_id: str = "doc_id") -> None:
    """Brings the index up to date: new, changed and, where ``deleted`` is true, deleted documents.

    Documents are known by their id; of rows that repeat one, any may stand. Only the
    shards that hold an old or a new version of one of them are read and replaced, and
    they are then as ``build_index`` with the same model would have made them. Running
    an update again changes nothing, so a repeated micro-batch does no harm.
    """
    spark = changes.sparkSession
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    batch = materialise(changes.withColumn("_gone", gone).dropDuplicates([doc_id]).select("collection", F.col(doc_id).alias("doc_id"), "embedding", "_gone"), "index-changes")
    fresh = materialise(_assigned(batch.where(~F.col("_gone")), model, "doc_id"), "index-fresh")
    stored = spark.read.parquet(path)
    known = batch.select("doc_id").distinct()
    shard = F.pmod("cell", F.lit(SHARDS)).cast("int")
    old = stored.select("shard", F.explode("ids").alias("doc_id")).join(known, "doc_id", "left_semi").select("shard")
    # at most SHARDS numbers
    touched = sorted(r[0] for r in old.unionByName(fresh.select(shard.alias("shard"))).distinct().collect())
    lists = stored.where(F.col("shard").isin(touched))
    width = model.cells.shape[1]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in batches:
            for i in range(len(lists)):
                ids, flat = lists.column("ids")[i].values, np.frombuffer(lists.column("vectors")[i].as_py())
                rows = pa.array(np.full(len(ids), i))
                yield pa.RecordBatch.from_arrays([lists.column("collection").take(rows), ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), pa.array(flat)),
                                                  lists.column("cell").take(rows)], ["collection", "doc_id", "v", "cell"])

    kept = lists.select("collection", "cell", "ids", "vectors").mapInArrow(unpack, fresh.schema).join(known, "doc_id", "left_anti").select(*fresh.columns)
    rows = materialise(kept.unionByName(fresh), "index-shards")  # the folder is overwritten, so it cannot be read on
    filled = {r[0] for r in rows.select(shard.alias("shard")).distinct().collect()}
    _write(rows, model, path, part)
    for empty in set(touched) - filled:  # a shard that lost its last document
        lists.where(F.col("shard") == empty).withColumn("ids", F.slice("ids", 1, 0)).withColumn("codes", F.lit(b"")).withColumn("vectors", F.lit(b"")).limit(1).transform(
            lambda df: materialise(df, "index-empty")).write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def stream_index(changes: DataFrame, model: IndexModel, path: str, checkpoint: str, part: int = PART, doc_id: str = "doc_id"):
    """Keeps the index up to date with a stream of documents (see ``update_index``), one micro-batch after the other."""
    return (changes.writeStream.foreachBatch(lambda batch, _: update_index(batch, model, path, part, doc_id))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.size("ids") > 0)


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides in single precision, unless that is too small for them, and the most by which a product of a row of ``a`` may be off."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1).max(initial=0)
    kind = np.float32 if norm_a.max(initial=0) * norm_b < 1e30 else np.float64
    with np.errstate(over="ignore"):
        return a.astype(kind), np.ascontiguousarray(b.astype(kind).T), (a.shape[1] + 10) * 2.0 ** -23 * norm_a * norm_b


def _levels(vectors: np.ndarray, documents: np.ndarray, survivors: int) -> np.ndarray:
    """Per vector, scores that its best 1, 2, 3 … times ``survivors // LEVELS`` documents reach, in that order."""
    step, n = max(1, survivors // LEVELS), min(survivors, len(documents))
    a, b, error = _products(vectors, documents)
    out = np.empty((len(a), n // step))
    for low in range(0, len(a), TILE_QUESTIONS):
        rows = slice(low, low + TILE_QUESTIONS)
        guess = a[rows] @ b
        guess[~np.isfinite(guess)] = -np.inf
        best = np.sort(np.partition(guess, len(documents) - n, axis=1)[:, len(documents) - n:], axis=1)[:, ::-1]
        out[rows] = best[:, step - 1::step].astype(np.float64) - error[rows, None]
    return np.where(np.isnan(out), -np.inf, out)


def _reaching(vectors: np.ndarray, documents: np.ndarray, floor: np.ndarray, survivors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, document, score) of each vector's best ``survivors`` documents with a finite score of at least its ``floor``.

    Products in single precision pass over what is below the floor by more than their error.
    """
    a, b, error = _products(vectors, documents)
    near = floor - error
    if a.dtype == np.float32:
        near = np.nextafter(near.astype(np.float32), np.float32(-np.inf))
    room = np.empty(TILE_QUESTIONS * TILE_CODES, a.dtype)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low in range(0, len(a), TILE_QUESTIONS):
        tile = a[low:low + TILE_QUESTIONS]
        for first in range(0, b.shape[1], TILE_CODES):
            codes = b[:, first:first + TILE_CODES]
            n, m = len(tile), codes.shape[1]
            guess = np.matmul(tile, codes, out=room[:n * m].reshape(n, m))
            some = np.flatnonzero(~(guess.max(axis=1) < near[low:low + n]))  # what is no number is settled below
            if not len(some):
                continue
            row, col = np.divmod(np.flatnonzero(~(guess[some] < near[low + some, None])), m)
            row, col = low + some[row], first + col
            if 8 * len(row) > n * m:
                score = (vectors[low:low + n] @ documents[first:first + m].T)[row - low, col - first]
            else:
                score = np.einsum("ij,ij->i", vectors[row], documents[col])
            kept = np.flatnonzero((score >= floor[row]) & np.isfinite(score))
            found.append((row[kept], col[kept], score[kept]))
    row, col, score = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(row) and np.bincount(row).max() > survivors:
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        within = np.arange(len(row)) - np.searchsorted(row, row) < survivors
        row, col, score = row[within], col[within], score[within]
    return row, col, score


def indexed_topk(questions: DataFrame, index: DataFrame, model: IndexModel, k: int = fv.PER_COLLECTION_K, min_score: float = fv.MIN_RELEVANCE,
                 probes: int = PROBES, survivors: int = SURVIVORS, question_id: str = "question_id", block: int = BLOCK) -> DataFrame:
    """Nearest ``k`` documents per (question, collection), as ``vectors.vector_topk`` gives them, among those of the probed cells.

    Codes choose ``survivors`` candidates per question and collection; their scores are
    exact. With all cells probed and survivors for all documents the result is exact.
    Columns: question_id, collection, doc_id, score, rank. Questions without a vector
    or an id find nothing.

    The nearest cells are scored first and settle a floor: a score that ``survivors``
    candidates reach at least. Parts then return only what reaches it, so candidates do not
    grow with the number of parts. Questions, their cells and floors are stored.
    """
    spark = questions.sparkSession
    # a number for each of the model's cells
    sizes = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect()}
    width, counts = model.cells.shape[1], np.array([sizes.get(c, 0) for c in range(len(model.cells))])
    shared = spark.sparkContext.broadcast((model, counts))  # of the model's fixed size
    asked = questions.where(F.col("embedding").isNotNull() & F.col(question_id).isNotNull()).select(F.col(question_id).alias("question_id"), F.col("embedding").cast("array<double>").alias("v"))
    q_type, types = asked.schema["question_id"].dataType.simpleString(), {f.name: f.dataType.simpleString() for f in index.schema}
    d_type, c_type = types["ids"][6:-1], types["collection"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value
        for batch in batches:
            if not len(batch):
                continue
            vectors, cells, first = _matrix(batch.column("v")).astype(np.float64), [], []
            for mine in model.nearest(vectors, probes):
                before = np.cumsum(counts[mine], axis=1) - counts[mine]
                cells.append(mine)
                first.append((np.arange(mine.shape[1]) < NEAR) | (before < NEAR_SURVIVORS * survivors))
            yield pa.RecordBatch.from_arrays([batch.column("question_id"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(list(np.concatenate(cells, axis=1).astype(np.int32)), pa.list_(pa.int32())),
                                              pa.array(list(np.concatenate(first, axis=1)), pa.list_(pa.bool_()))], ["question_id", "v", "cells", "first"])

    asked = materialise(asked.mapInArrow(probe, f"question_id {q_type}, v binary, cells array<int>, first array<boolean>"), "index-asked")
    lists = index.groupBy("collection", "cell").agg(F.count(F.lit(1)).alias("parts"))  # a row for each list
    same = lambda *names: [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names]
    named = lambda df, *names: df.withColumnsRenamed({name: f"_{name}" for name in names})

    def met(probed: DataFrame, floor: str) -> DataFrame:
        """Blocks of about ``block`` questions (question_id, v, floor) of a cell beside each part of its lists."""
        blocks = F.ceil(F.lit(1.0) * F.count(F.lit(1)) / F.lit(block)).cast("int")
        sizes = probed.groupBy("cell").agg(blocks.alias("blocks")).join(lists, "cell").select("cell", "collection", "blocks")  # a row for each list
        packed = (probed.join(sizes, "cell").withColumn("qb", F.pmod(F.xxhash64("question_id"), "blocks"))
                  .groupBy("collection", "cell", "qb").agg(F.collect_list(F.struct("question_id", "v", F.expr(floor).cast("double").alias("floor"))).alias("asked")))
        parts = named(index.select("collection", "cell", "part", "codes"), "collection", "cell")
        return packed.join(parts, same("collection", "cell")).select("asked", "collection", "cell", "part", "codes")

    def unpacked(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        return rows.field("question_id"), np.frombuffer(b"".join(rows.field("v").to_pylist())).reshape(len(rows), width)

    def decoded(batch: pa.RecordBatch, i: int) -> np.ndarray:
        model = shared.value[0]
        return model.decode(np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(-1, model.books.shape[0]), batch.column("cell")[i].as_py())

    def repeated(batch: pa.RecordBatch, name: str, i: int, n: int) -> pa.Array:
        return batch.column(name).take(pa.array(np.full(n, i)))

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, vectors = unpacked(batch.column("asked")[i].values)
                found = _levels(vectors, decoded(batch, i), survivors)
                yield pa.RecordBatch.from_arrays([ids, repeated(batch, "collection", i, len(ids)), pa.array(list(found), pa.list_(pa.float64()))], ["question_id", "collection", "levels"])

    # each level stands for ``step`` documents of its part: so many levels make all survivors
    step = max(1, survivors // LEVELS)
    reached = F.get(F.sort_array(F.flatten(F.collect_list("levels")), asc=False), F.lit(-(-survivors // step) - 1))
    nearest = asked.select("question_id", "v", F.explode(F.arrays_zip("cells", "first")).alias("at")).where("at.first").select("question_id", "v", F.col("at.cells").alias("cell"))
    floors = (met(nearest, "null").mapInArrow(levels, f"question_id {q_type}, collection {c_type}, levels array<double>")
              .groupBy("question_id", "collection").agg(reached.alias("floor")).where(F.col("floor").isNotNull())
              .groupBy("question_id").agg(F.collect_list(F.struct("collection", "floor")).alias("floors")))
    floors = materialise(floors, "index-floors")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked = batch.column("asked")[i].values
                ids, vectors = unpacked(asked)
                floor = asked.field("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                rows, columns, guesses = _reaching(vectors, decoded(batch, i), floor, survivors)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *(repeated(batch, name, i, n) for name in ("collection", "cell", "part")), pa.array(columns.astype(np.int32)), pa.array(guesses)],
                                                 ["question_id", "collection", "cell", "part", "pos", "guess"])

    probed = asked.join(floors, "question_id", "left").select("question_id", "v", "floors", F.explode("cells").alias("cell"))
    guesses = (met(probed, "get(filter(floors, x -> x.collection <=> collection), 0).floor")
               .mapInArrow(candidates, f"question_id {q_type}, collection {c_type}, cell int, part int, pos int, guess double"))
    w = W.partitionBy("question_id", "collection")
    chosen = (guesses.withColumn("n", F.row_number().over(w.orderBy(F.desc("guess"), "cell", "part", "pos"))).where(F.col("n") <= survivors)
              .groupBy("question_id", "collection", "cell", "part").agg(F.collect_list("pos").alias("places")))
    # per list part: the questions that want some of its rows, in blocks
    n_blocks = F.greatest(F.lit(1), F.ceil(asked.agg(F.count(F.lit(1))).scalar() / F.lit(EXACT_BLOCK))).cast("int")
    wanted = (chosen.join(asked.select("question_id", "v"), "question_id").groupBy("collection", "cell", "part", F.pmod(F.xxhash64("question_id"), n_blocks).alias("qb"))
              .agg(F.collect_list(F.struct("question_id", "v", "places")).alias("asked")))

    def rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked = batch.column("asked")[i].values
                ids, vectors = unpacked(asked)
                lists = asked.field("places")
                places, rows = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
                documents = np.frombuffer(batch.column("vectors")[i].as_py()).reshape(len(batch.column("ids")[i]), -1)
                for low in range(0, len(rows), 1 << 16):
                    row, place = rows[low:low + (1 << 16)], places[low:low + (1 << 16)]
                    exact = np.einsum("ij,ij->i", vectors[row], documents[place])
                    kept = np.flatnonzero(exact >= min_score)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[kept])), repeated(batch, "collection", i, len(kept)), batch.column("ids")[i].values.take(pa.array(place[kept])),
                                                      pa.array(np.round(exact[kept], 4))], ["question_id", "collection", "doc_id", "score"])

    full = named(index.select("collection", "cell", "part", "ids", "vectors"), "collection", "cell", "part")
    found = (wanted.join(full, same("collection", "cell", "part")).select("asked", "collection", "ids", "vectors")
             .mapInArrow(rescored, f"question_id {q_type}, collection {c_type}, doc_id {d_type}, score double"))
    return found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
