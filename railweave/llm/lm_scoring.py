"""Cross-entropy difference between a target and a background language model.

Both are bigram models over one vocabulary, counted over all distinct texts: the
background on every text, the target on the texts of the wanted kind. A bigram's
probability is its count mixed with the unigram's probability (Dirichlet smoothing). A
document's score is the mean over its words of target loss minus background loss: the
lower, the closer.

A text is scored by what the other texts hold: its own occurrences are taken off all
counts first, and copies of a text are one text, so a wanted text is judged as an equally
good one that nobody labelled.

Nothing is pruned: every word and every bigram keeps its own counts, so what is gathered
grows with the corpus. An occurrence goes to the bucket of its word, where all counts
that its probability needs meet; the buckets send back sums, one row for a slice of
texts. Words and pairs so frequent that they would fill a bucket are counted first, sent
to all tasks and scored where they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.functions.runtime import materialise, scratch_path
from railweave.llm.common import give_back, hash_cut, mix64, scan, slices, word_hashes

PRIOR = 50.0
#: Shares from which words and pairs are scored without a shuffle, and the texts in which such pairs are looked for.
HOT_WORDS, HOT_PAIRS, SAMPLE = 2e-5, 2.5e-6, 4_000
#: Words with more occurrences are frequent whatever their share, so no bucket's group grows
#: with the corpus; what is broadcast is at most 40 bytes for so many words of the corpus.
GROUP = 4_000_000
#: Occurrences that a bucket holds, on average.
BUCKET = 3_000_000
#: Stands for the beginning of a text among the hashes.
START = np.uint64(1)
COUNTED, SCORED, WANTED, MEMBER = 1, 2, 4, 8


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); A-Z lower-cased, null has none."""
    coded = [x.encode().lower() if x else b"" for x in texts]
    begin = np.cumsum([0, *(len(x) + 1 for x in coded)])
    start, hashes = word_hashes(b"\n".join(coded))
    return hashes, np.diff(np.searchsorted(start, begin))


@dataclass
class Vocabulary:
    """Sorted hashes; a word's id is its place plus one, 0 stands for all others."""

    hashes: np.ndarray

    @property
    def width(self) -> int:
        return len(self.hashes) + 2

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at, there = _find(self.hashes, hashes)
        return np.where(there, at + 1, 0)


@dataclass
class HotCounts:
    """Counts (rows: background, target) of frequent words, also as contexts, and of frequent pairs of them, by sorted keys."""

    vocabulary: Vocabulary
    of_words: np.ndarray
    of_contexts: np.ndarray
    pairs: np.ndarray
    of_pairs: np.ndarray


@dataclass
class Models:
    """Counts of all words and pairs, gathered from the distinct texts when documents are scored."""

    docs: DataFrame
    texts: DataFrame
    prior: float
    bucket: int
    every: np.ndarray
    total: int
    hot: HotCounts


@dataclass
class Occurrences:
    """Words of some texts: hash and its predecessor's, text, whether it ends the text."""

    word: np.ndarray
    context: np.ndarray
    text: np.ndarray
    last: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Occurrences:
        word, counts = _joined(texts)
        end = np.cumsum(counts)
        context = np.concatenate([[START], word[:-1]]).astype(np.uint64)[:len(word)]
        context[(end - counts)[counts > 0]] = START
        last = np.zeros(len(word), bool)
        last[end[counts > 0] - 1] = True
        return Occurrences(word, context, np.repeat(np.arange(len(texts)), counts), last, counts)


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among sorted keys, whether it is there) of each value."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _key(text: str):
    """128-bit digest of a text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distinct(docs: DataFrame, text: str, marks: list[DataFrame]) -> DataFrame:
    """(key, row, text, and a column for each of ``marks``) of the distinct texts; row is a number of its own.

    A mark is a table (key, column). Copies are reduced before the shuffle.
    """
    out = docs.filter(F.col(text).isNotNull()).select(_key(text).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    for mark in marks:
        out = out.join(mark.hint("merge"), "key", "left")
    return out.withColumn("row", F.monotonically_increasing_id())


def _usage(texts: DataFrame) -> DataFrame:
    """(h, n, t, m, u): how often each word is in all and in wanted texts, and there before another word."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = Occurrences.of(batch.column("text").to_pylist())
        wanted, some = _flags(batch) & WANTED > 0, at.counts > 0
        keys, inverse = np.unique(at.word, return_inverse=True)
        marks = (np.ones(len(at.word)), wanted[at.text], ~at.last, wanted[at.text] & ~at.last)
        sums = [np.concatenate([np.bincount(inverse, x, len(keys)), [first]]).astype(np.int64) for x, first in zip(marks, (0, 0, some.sum(), (some & wanted).sum()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, [START]]).astype(np.uint64).view(np.int64)), *map(pa.array, sums)], ["h", *"ntmu"])

    return scan(texts.select("flags", "text"), run, "h long, n long, t long, m long, u long").groupBy("h").agg(*(F.sum(x).alias(x) for x in "ntmu"))


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("flags").to_numpy(zero_copy_only=False)


def _hot_pairs(texts: DataFrame, known: Vocabulary, pair_share: float, sample: int) -> pa.Table:
    """(pair, n, t) of pairs of frequent words, counted over all texts; a sample tells which ones are worth it."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def few(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = _pairs(shared.value, Occurrences.of(batch.column("text").to_pylist()))
        keys, n = np.unique(pair[pair >= 0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

    part = texts.select("text", "row")
    sampled = materialise(scan(part.filter(hash_cut(part, "row", sample)).select("text"), few, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "sample")
    words = sampled.agg(F.sum("n").alias("n")).first()["n"] or 0
    # at most 1 / pair_share rows
    chosen = np.sort(sampled.filter(F.col("n") >= max(2, pair_share * words)).select("pair").toArrow().column("pair").to_numpy())
    picked = texts.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        sums = np.zeros((2, len(picked.value)), np.int64)
        for batch in (x for y in batches for x in slices(iter([y]))):
            at = Occurrences.of(batch.column("text").to_pylist())
            place, there = _find(picked.value, _pairs(shared.value, at))
            for row, mask in enumerate((there, there & (_flags(batch) & WANTED > 0)[at.text])):
                sums[row] += np.bincount(place[mask], minlength=sums.shape[1])
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(picked.value[used]), *(pa.array(x[used]) for x in sums)], ["pair", "n", "t"])
        give_back()

    counted = texts.select("flags", "text").mapInArrow(run, "pair long, n long, t long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow().sort_by("pair")


def _pairs(known: Vocabulary, at: Occurrences) -> np.ndarray:
    """Context id * width + word id where both are frequent, else -1."""
    word, context = known.ids(at.word), known.ids(at.context)
    return np.where((word > 0) & (context > 0), context * known.width + word, -1)


def fit(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float = PRIOR,
        hot_words: float = HOT_WORDS, hot_pairs: float = HOT_PAIRS, bucket: int = BUCKET, sample: int = SAMPLE, group: int = GROUP) -> Models:
    """target: a table whose doc_id names the texts of the wanted kind; null ids name none.

    A text is wanted if any of its copies is named. hot_words, hot_pairs, bucket, sample
    and group change how the work is dealt out, not the result.
    """
    # joined by shuffle at every size, as the table of wanted texts grows with the corpus
    named = target.select(F.col(doc_id).alias("_id")).dropna().distinct().hint("merge")
    wanted = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), _key(text).alias("key")).join(named, "_id").select("key").distinct().withColumn("wanted", F.lit(True))
    flags = F.lit(COUNTED | SCORED | MEMBER) + F.when(F.col("wanted"), WANTED).otherwise(0)
    texts = _written(_distinct(docs, text, [wanted]).select("key", "row", flags.cast("int").alias("flags"), "text"), "texts")
    words = materialise(_usage(texts), "words")
    sums = words.agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum((F.col("n") > 0).cast("long")).alias("words")).first()
    total = sums["n"] or 0
    # at most 1 / hot_words + total / group rows and the beginning
    rows = words.filter((F.col("n") >= min(hot_words * total, group)) | (F.col("h") == int(START))).toArrow()
    keys = rows.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    of_words, of_contexts = (np.stack([rows.column(x).to_numpy()[order] for x in pair]).astype(np.int64) for pair in ("nt", "mu"))
    known = Vocabulary(keys[order])
    pairs = _hot_pairs(texts, known, hot_pairs, sample)
    hot = HotCounts(known, of_words, of_contexts, pairs.column("pair").to_numpy(), np.stack([pairs.column(x).to_numpy() for x in "nt"]))
    every = np.array([total, sums["t"] or 0], np.float64) + (sums["words"] or 0) + 2
    return Models(docs, texts, prior, bucket, every, total, hot)


def _groups(key: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Sums of the weights over equal neighbouring keys, given to each of them."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    place = np.cumsum(new) - 1
    return [np.bincount(place, x)[place] for x in weights]


def _own(*keys: np.ndarray) -> np.ndarray:
    """How many rows agree with each row in all keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
    place = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(place)[place]
    return out


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in two or four bytes each, as they fit."""
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) <= 2 * n else np.uint32).astype(np.int64)


_PAIR_BITS = 40  # within a word's group


def _short(pairs: np.ndarray) -> bytes:
    return pairs.astype(np.uint32).tobytes() + (pairs >> np.uint64(32)).astype(np.uint8).tobytes()


def _long(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


#: What a bucket is sent from a slice of texts: the slice, its size, the texts' places, flags and
#: words, occurrences of frequent words (text, pair, word, the word's number in the text), and of others.
PACK = ("places", "flags", "words", "hot_at", "hot_pair", "hot_word", "hot_own", "rare_at", "rare_word", "rare_pair")
_LAST = np.uint16(1 << 15)


def score(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, loss_target, loss_background, score (their difference).

    A text that the models were counted on is scored without its own occurrences. A null,
    empty or blank text has no words and null losses. Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    shared, prior, every = context.broadcast(models.hot), models.prior, models.every[:, None]
    n_buckets = np.uint64(max(1, -(-models.total // models.bucket)))
    texts = models.texts
    if docs is not models.docs:
        known = texts.select("key", F.col("flags").bitwiseAND(WANTED).alias("wanted"))
        flags = F.lit(SCORED) + F.when(F.col("wanted").isNotNull(), F.col("wanted") + MEMBER).otherwise(0)
        scored = _written(_distinct(docs, text, [known]).select("key", (-1 - F.col("row")).alias("row"), flags.cast("int").alias("flags"), "text"), "scored")
        texts = texts.withColumn("flags", F.col("flags").bitwiseAND(~SCORED)).unionByName(scored)
    source = texts.select("row", "flags", "text")

    def located(batch: pa.RecordBatch) -> tuple:
        """Occurrences, and for each the place of its word, its context and both among the frequent ones, and whether they are there."""
        known = shared.value.vocabulary
        at = Occurrences.of(batch.column("text").to_pylist())
        word, first = _find(known.hashes, at.word)
        before, second = _find(known.hashes, at.context)
        return at, (word, first), (before, second), _find(shared.value.pairs, np.where(first & second, (before + 1) * known.width + word + 1, -1))

    def own(at: Occurrences, place: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """How often each occurrence's place is in its text, 0 outside the mask."""
        out = np.zeros(len(place), np.int64)
        out[mask] = _own(at.text[mask], place[mask])
        return out

    def less(flags: np.ndarray, k: int) -> np.ndarray:
        """1 for texts whose own occurrences are in the counts."""
        return ((flags & MEMBER) > 0 if k == 0 else (flags & (MEMBER | WANTED)) == MEMBER | WANTED).astype(np.float64)

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Per slice of texts: what frequent words and pairs add."""
        hot, (at, (word, first), (before, second), (place, there)) = shared.value, located(batch)
        flags, sums = _flags(batch), []
        own_word, own_before, own_pair = own(at, word, first), own(at, before, second), own(at, place, there)
        for k in (0, 1):
            off = less(flags, k)
            mine, rest = off[at.text], (every[k] - off * at.counts)[at.text]
            logs = np.zeros(len(at.word))
            logs[second] -= np.log(hot.of_contexts[k][before[second]] - (mine * own_before)[second] + prior)
            logs[there] += np.log(hot.of_pairs[k][place[there]] - (mine * own_pair)[there] + prior * (hot.of_words[k][word[there]] - (mine * own_word)[there] + 1) / rest[there])
            sums.append(np.bincount(at.text, logs, len(flags)))
        taken = np.flatnonzero(flags & SCORED)
        return _sums(batch.column("row")[0].as_py(), taken, *(x[taken] for x in sums), batch.column("row").to_numpy()[taken], at.counts[taken])

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Other occurrences by bucket: pairs of a frequent word meet by pair, others by word."""
        at, (word, first), _, (_, there) = located(batch)
        flags = _flags(batch).astype(np.uint8)
        mine = own(at, word, first)
        left = np.flatnonzero(~there)
        pair = mix64(at.word[left] + mix64(at.context[left]))
        bucket = ((mix64(np.where(first[left], pair, at.word[left])) >> np.uint64(20)) % n_buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        left, pair, bucket = left[order], pair[order] & np.uint64((1 << _PAIR_BITS) - 1), bucket[order]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
        packs = []
        for start, end in zip(edge[:-1], edge[1:], strict=True):
            part, pairs = left[start:end], pair[start:end]
            frequent = first[part]
            rare = ~frequent
            found, index = np.unique(at.text[part], return_inverse=True)
            index = index.astype(np.uint16)
            packs.append([found.astype(np.uint16).tobytes(), flags[found].tobytes(), at.counts[found].astype(np.uint32).tobytes(),
                          index[frequent].tobytes(), _short(pairs[frequent]), _narrow(word[part[frequent]]), _narrow(mine[part[frequent]]),
                          (index[rare] | np.where(at.last[part[rare]], _LAST, np.uint16(0))).tobytes(), at.word[part[rare]].tobytes(), _short(pairs[rare])])
        n = len(packs)
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]] if len(bucket) else [], pa.int32()), pa.array([batch.column("row")[0].as_py() if n else 0] * n, pa.int64()),
                                           *(pa.array([x[k] for x in packs], pa.binary()) for k in range(len(PACK)))], ["bucket", "slice", *PACK])

    def gather(table: pa.Table) -> pa.Table:
        hot, packs = shared.value, {name: table.column(name).to_pylist() for name in PACK}
        sizes = [len(x) for x in packs["flags"]]
        shift = np.cumsum([0, *sizes])
        flags = np.frombuffer(b"".join(packs["flags"]), np.uint8)
        words = np.frombuffer(b"".join(packs["words"]), np.uint32).astype(np.float64)
        off = [less(flags, k) for k in (0, 1)]
        counts = np.stack([flags & COUNTED, (flags & (COUNTED | WANTED)) == COUNTED | WANTED]).astype(np.float64)
        sums = np.zeros((2, len(flags)))
        each = [[np.frombuffer(x, np.uint16) for x in packs[name]] for name in ("hot_at", "rare_at")]
        index = [np.concatenate([(x & ~_LAST).astype(np.int64) + s for x, s in zip(xs, shift, strict=False)]) for xs in each]
        if len(index[0]):
            pair = np.concatenate([_long(x) for x in packs["hot_pair"]])
            word, mine = (np.concatenate([_wide(x, len(y)) for x, y in zip(packs[name], each[0], strict=True)]) for name in ("hot_word", "hot_own"))
            order = np.lexsort((pair, word))
            pair, word, mine, text = pair[order], word[order], mine[order], index[0][order]
            both, own_pair = mix64(pair + mix64(word.astype(np.uint64))), _own(text, pair, word)
            for k, n in enumerate(_groups(both, *counts[:, text])):
                m = off[k][text]
                sums[k] += np.bincount(text, np.log(n - m * own_pair + prior * (hot.of_words[k][word] - m * mine + 1) / (every[k] - m * words[text])), len(flags))
        if len(index[1]):
            pair, word = np.concatenate([_long(x) for x in packs["rare_pair"]]), np.frombuffer(b"".join(packs["rare_word"]), np.uint64)
            inner = np.concatenate([x & _LAST for x in each[1]]) == 0
            order = np.lexsort((pair, word))
            word, pair, text, inner = word[order], pair[order], index[1][order], inner[order]
            own_pair, own_word = _own(text, pair, word), _own(text, word)
            own_context = np.zeros(len(word), np.int64)
            own_context[inner] = _own(text[inner], word[inner])
            both = mix64(pair + mix64(word))
            for k in (0, 1):
                weight, m = counts[k][text], off[k][text]
                of_word, of_context = _groups(word, weight, weight * inner)
                n, = _groups(both, weight)
                logs = np.log(n - m * own_pair + prior * (of_word - m * own_word + 1) / (every[k] - m * words[text]))
                logs -= np.where(inner, np.log(of_context - m * own_context + prior), 0)
                sums[k] += np.bincount(text, logs, len(flags))
        out = []
        for number, places, start, end in zip(table.column("slice").to_pylist(), packs["places"], shift[:-1], shift[1:], strict=True):
            taken = np.flatnonzero(flags[start:end] & SCORED)
            out.append(_sums(number, np.frombuffer(places, np.uint16)[taken], *(x[start:end][taken] for x in sums)))
        return pa.Table.from_batches(out, _SUMS)

    def add(table: pa.Table) -> pa.Table:
        """All sums of a slice; the row that knows its texts says which they are."""
        packs = [{name: x for name, x in row.items() if x is not None} for row in table.to_pylist()]
        kept = [np.frombuffer(x["places"], np.uint16) for x in packs]
        sums = np.zeros((2, 1 + max((int(x.max()) for x in kept if len(x)), default=0)))
        for places, x in zip(kept, packs, strict=True):
            for k, name in enumerate("bt"):
                sums[k, places] += np.frombuffer(x[name])
        base = next(x for x in packs if "rows" in x)
        places = np.frombuffer(base["places"], np.uint16)
        return pa.table([pa.array(np.frombuffer(base["rows"], np.int64)), pa.array(np.frombuffer(base["counts"], np.int64)), *(pa.array(x[places]) for x in sums)], names=["row", "n_words", "b", "t"])

    def _sums(number: int, places: np.ndarray, b: np.ndarray, t: np.ndarray, rows: np.ndarray | None = None, counts: np.ndarray | None = None) -> pa.RecordBatch:
        packs = [None if x is None else x.tobytes() for x in (places.astype(np.uint16), b, t, rows, None if counts is None else counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packs)], schema=_SUMS)

    columns = "slice long, places binary, b binary, t binary, rows binary, counts binary"
    sent = scan(source, send, "bucket int, slice long" + "".join(f", {x} binary" for x in PACK)).groupBy("bucket").applyInArrow(gather, columns)
    summed = scan(source, settle, columns).unionByName(sent).groupBy("slice").applyInArrow(add, "row long, n_words long, b double, t double")
    # one row for each distinct text, joined by shuffle, which splits texts with many copies
    losses = materialise(texts.select("key", "row").join(summed, "row").drop("row"), "losses")
    every_row = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(_key(text), F.unhex(F.lit("00"))).alias("key"))
    out = every_row.join(losses, "key", "left")
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), (-F.col("t") / words).alias("loss_target"), (-F.col("b") / words).alias("loss_background"), ((F.col("b") - F.col("t")) / words).alias("score"))


_SUMS = pa.schema([("slice", pa.int64()), *((c, pa.binary()) for c in ("places", "b", "t", "rows", "counts"))])
