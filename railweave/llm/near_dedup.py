"""MinHash near-duplicates through SetSketch registers.

A document's set is its distinct five-word shingles. A register keeps the smallest
of the set's exponential hash values, truncated to a power of a base near one, so
the sketch of a union is the maximum of the sketches, register by register.

1. ``sketch`` reads the texts once: set size, 128-bit digest of the set, registers.
2. Equal sets become one node. Bands of registers meet in buckets; every member is
   paired with the bucket's first member only. The joint likelihood of two sketches
   drops hopeless pairs, the rest are verified on the full sets.
3. Buckets that still hold members of several components are compared in full, in
   blocks of bounded size: sketches first, then full sets. A block returns the links
   that unite components, never all pairs.
4. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.functions.runtime import materialise
from railweave.llm.common import mix64, scan, word_hashes

REGISTERS, BAND, SHINGLE = 192, 4, 5
#: Registers take values 0..LEVELS on a scale of powers of BASE; RATE shifts the scale.
BASE, RATE, LEVELS = 1.001, 20.0, 65_535
SIMILARITY = (75, 100)
#: A pair goes on to the full sets if its estimate is at most this far below the threshold (six standard errors).
MARGIN = 6 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Members and shingles of one block of a bucket that is compared in full, on average.
BLOCK, BLOCK_SHINGLES = 512, 500_000

_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_FACTOR = (_RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ORDER = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets_of(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of whole texts.

    Words are what white space separates, A-Z lower-cased; a shorter text is one
    shingle, a text without words has none.
    """
    coded = [x.encode().lower() if x else b"" for x in texts]
    begin = np.cumsum([0, *(len(x) + 1 for x in coded)])
    start, hashes = word_hashes(b"\n".join(coded))
    word = np.searchsorted(start, begin)
    total = np.full(max(0, len(hashes) - shingle + 1), shingle, np.uint64)
    for k in range(shingle if len(total) else 0):
        total += hashes[k:k + len(total)] * _ORDER[k % len(_ORDER)]
    total = mix64(total)
    out = []
    for a, b in zip(word[:-1], word[1:], strict=True):
        if b - a >= shingle:
            values = np.sort(total[a:b - shingle + 1])
            fresh = np.ones(len(values), bool)
            np.not_equal(values[1:], values[:-1], out=fresh[1:])
            out.append(values[fresh])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                one += hashes[a + k:a + k + 1] * _ORDER[k]
            out.append(mix64(one))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch of a set of hashes; all zero for the empty set."""
    return _levels(_minima(hashes)[None, :])[0] if len(hashes) else np.zeros(REGISTERS, np.uint16)


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the set's hash values, for each register."""
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    least = []
    for k in range(0, len(half), 256):
        values = np.bitwise_xor(half[None, k:k + 256], _FLIP)
        values *= _FACTOR
        least.append(values.min(axis=1))
    return np.min(least, axis=0)


def _levels(least: np.ndarray) -> np.ndarray:
    """Truncated exponential scale of minima of uniform values."""
    waiting = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(waiting) / np.log(BASE)), 0, LEVELS).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows), given the set sizes."""
    m = a.shape[1]
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = m - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u

    def chance(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = np.maximum(chance(np.maximum(u - v * j, 0)), 1e-12), np.maximum(chance(np.maximum(v - u * j, 0)), 1e-12)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def linked(common: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The contract's rule on exact counts."""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (size_a + size_b - common)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, k1 and k2 (digest of the set), regs."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = shingle_sets_of(batch.column(1).to_pylist())
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
        filled = [k for k, x in enumerate(sets) if len(x)]
        regs: list[bytes | None] = [None] * len(sets)
        if filled:
            for k, levels in zip(filled, _levels(np.stack([_minima(sets[k]) for k in filled])), strict=True):
                regs[k] = levels.tobytes()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(regs, pa.binary())],
                                          ["doc_id", "n_shingles", "k1", "k2", "regs"])

    return scan(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_shingles long, k1 long, k2 long, regs binary")


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and its sorted shingle hashes as 64-bit words."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets_of(batch.column(1).to_pylist())], pa.binary())], ["doc_id", "hashes"])

    return scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, hashes binary")


def _rows(column: pa.Array, dtype) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), dtype) for x in column]) if len(column) else np.empty((0, REGISTERS), dtype)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """One hash per band of each row of registers."""
    cut = regs.reshape(len(regs), -1, BAND).astype(np.uint64)
    bucket = np.broadcast_to(np.arange(1, cut.shape[1] + 1, dtype=np.uint64), cut.shape[:2])
    for k in range(BAND):
        bucket = mix64(bucket * _ORDER[k] + cut[:, :, k])
    return bucket.view(np.int64)


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, doc_id) for every band of registers of every node."""
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                bucket = band_hashes(_rows(part.column(1), np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), bucket.shape[1]))], ["bucket", "doc_id"])

    return nodes.select("doc_id", "regs").mapInArrow(run, "bucket long, doc_id long")


def _likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule the link out."""
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                size_a, size_b = (part.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (3, 5))
                estimate = joint_estimate(_rows(part.column(2), np.uint16), _rows(part.column(4), np.uint16), size_a, size_b)
                keep = (estimate >= SIMILARITY[0] / SIMILARITY[1] - MARGIN) & (np.minimum(size_a, size_b) * SIMILARITY[1] >= np.maximum(size_a, size_b) * SIMILARITY[0])
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "regs_a", "size_a", "regs_b", "size_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with their full sets, reduced to the links."""
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(linked(common, len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long")


def _block_links(bucket: int, ids: np.ndarray, groups: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that unite components within a block, or between its two halves.

    ``left`` and ``right`` mark the members to be compared with each other. Pairs of
    one component are skipped, also once a link found here has united them. A pair
    that shares several buckets is compared in the first of its bands only.
    """
    parent = {int(g): int(g) for g in groups}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    band = int(np.argmax(band_hashes(regs[:1])[0] == bucket))
    floor = int(np.floor((SIMILARITY[0] / SIMILARITY[1] - MARGIN) * REGISTERS))
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    present = np.zeros(int(codes.max()) + 1, np.int8)
    links = []
    right_index = np.flatnonzero(right)
    for i in np.flatnonzero(left):
        others = right_index[right_index > i] if right[i] else right_index
        others = others[(np.minimum(sizes[others], sizes[i]) * SIMILARITY[1] >= np.maximum(sizes[others], sizes[i]) * SIMILARITY[0]) & (groups[others] != groups[i])]
        if len(others):
            same = regs[others] == regs[i]
            first = np.argmax(same.reshape(len(others), -1, BAND).all(axis=2), axis=1)
            others = others[(same.sum(axis=1) >= floor) & (first == band)]
        others = np.array([j for j in others if root(int(groups[j])) != root(int(groups[i]))], np.int64)
        if not len(others):
            continue
        present[codes[starts[i]:starts[i + 1]]] = 1
        for j in others:
            if root(int(groups[j])) != root(int(groups[i])) and linked(int(present[codes[starts[j]:starts[j + 1]]].sum()), sizes[i], sizes[j]):
                parent[root(int(groups[j]))] = root(int(groups[i]))
                links.append((int(ids[i]), int(ids[j])))
        present[codes[starts[i]:starts[i + 1]]] = 0
    return links


def _contended_links(buckets: DataFrame) -> DataFrame:
    """Compare buckets in full. buckets: bucket, blocks, doc_id, comp, regs, hashes.

    A small bucket is one block and one group; a larger one is cut into blocks, and
    each pair of blocks is a group, so a group is bounded.
    """
    placed = (buckets.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
              .select("bucket", "lo", "hi", "mine", "doc_id", "comp", "regs", "hashes"))

    def run(group: pa.Table) -> pa.Table:
        lo, hi, mine = group.column("lo")[0].as_py(), group.column("hi")[0].as_py(), group.column("mine").to_numpy()
        ids, comps = group.column("doc_id").to_numpy(), group.column("comp").to_numpy()
        links = []
        if len(ids) > 1 and (comps != comps[0]).any():
            order = np.argsort(ids, kind="stable")
            regs = _rows(group.column("regs").combine_chunks(), np.uint16)[order]
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes").combine_chunks()]
            mine = mine[order]
            links = _block_links(group.column("bucket")[0].as_py(), ids[order], comps[order], regs, [sets[k] for k in order], mine == lo, mine == hi)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return placed.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, comp): the smallest id of each component of the links (a, b).

    Alternates large-star and small-star steps until nothing changes; a node's
    neighbours are only ever reduced to their minimum, so no list is built.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        moved = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    print_of = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")]
    before = edges.agg(*print_of).first()
    while before["n"]:
        edges = materialise(star(star(edges, True), False), "links")
        after = edges.agg(*print_of).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("comp"))).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Two documents are linked if 100 * common shingles >= 75 * all their shingles.
    Null, empty and blank texts have no shingles and link with nothing. A row
    without doc_id takes no part: its component_id is null and it is kept. Rows that
    repeat a doc_id are one document with several texts. Other columns are ignored.
    """
    rows = materialise(sketch(docs, doc_id, text), "sketches")
    sets = rows.filter("doc_id is not null and n_shingles > 0")
    rep = sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = materialise(sets.select("doc_id", "k1", "k2").join(rep, ["k1", "k2"]).select("doc_id", "rep", "k1", "k2"), "copies")
    nodes = materialise(sets.join(member.filter("doc_id = rep").select("doc_id", "k1", "k2").distinct(), ["doc_id", "k1", "k2"], "left_semi")
                        .select("doc_id", "n_shingles", "regs"), "nodes")

    band = bands(nodes)
    first = band.groupBy("bucket").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size")).filter("b < top")
    shared = materialise(band.join(first, "bucket").select("bucket", "size", "doc_id", "b"), "buckets")
    pairs = shared.filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    side = [nodes.select(F.col("doc_id").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n_shingles").alias(f"size_{x}")) for x in "ab"]
    likely = materialise(_likely(pairs.join(side[0], "a").join(side[1], "b")).distinct(), "pairs")

    inside = shared.select("doc_id").unionByName(shared.select(F.col("b").alias("doc_id"))).distinct()
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(inside, "doc_id", "left_semi")
    full = materialise(shingle_sets(source), "sets")
    ha, hb = (full.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    star_links = materialise(_verified(likely.join(ha, "a").join(hb, "b")).distinct(), "links")
    same_id = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")

    comp = materialise(components(star_links), "components")
    sizes = nodes.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    labelled = shared.filter("size > 2").join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")).join(sizes, "doc_id").select("bucket", "doc_id", "comp", "n")
    # two members have been compared with each other already
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("blocks")).filter("lo < hi").select("bucket", "blocks")
    contended = (labelled.join(mixed, "bucket")
                 .join(nodes.select("doc_id", "regs"), "doc_id").join(full, "doc_id"))
    more = materialise(_contended_links(contended), "links")

    every = reduce(DataFrame.unionByName, [star_links, more, same_id])
    final = components(every)
    label = member.join(final.select(F.col("doc_id").alias("rep"), "comp"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component"))
    label = label.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they were, of which none is linked to one with a smaller doc_id.

    Rows without doc_id stay. Rows that repeat a doc_id stay or go together.
    """
    gone = near_duplicates(docs, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == F.col("_gone"), "left_anti")
