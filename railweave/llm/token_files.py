"""Token ids in binary files, coded word-aligned (Simple-8b).

A 64-bit word is four selector bits and 60 bits that hold 1 to 60 ids of equal width,
or 120 zeros. Ids of 60 bits and more go to a list of escapes that the word points to.
Blocks of BLOCK ids start at a word of their own; their offsets allow decoding a block
alone, and all words of a page at once, without walking through them.

The files are a Parquet table of pages, so Spark commits them whole and tasks may be
run again. A page holds whole documents. Its row: shard, page, first (ids before it
in the shard), doc_ids, lengths, words, offsets, escapes.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railweave.functions.runtime import scratch_path
from railweave.llm.common import give_back, slices

BLOCK = 512
END_ID = 0
#: Selector: ids in a word and bits of each. Selector 0 is an escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_POWERS = np.uint64(1) << np.arange(60, dtype=np.uint64)
_SMALL_WIDTHS = np.searchsorted(_POWERS, np.arange(1 << 20, dtype=np.uint64), side="right").astype(np.int8)
_SELECTOR = {int(c): s for s, c in enumerate(COUNTS) if s}
PAGE_SCHEMA = "shard int, page int, first long, doc_ids array<long>, lengths array<long>, words binary, offsets binary, escapes binary"


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if len(ids) and ids.max() < np.uint64(1 << 20):
        return _SMALL_WIDTHS[ids.astype(np.int64)]
    return np.searchsorted(_POWERS, ids, side="right").astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, escapes) of any 64-bit ids; offsets: the first word of each block, and the end."""
    ids = np.asarray(ids, np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    # behind a block's end stand ids too wide for any run
    width = np.full((n_blocks, BLOCK + 128), 127, np.int8)
    flat = np.full(n_blocks * BLOCK, 127, np.int8)
    flat[:len(ids)] = _width(ids)
    width[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    best, widest, reach = np.ones((n_blocks, BLOCK), np.int8), width[:, :BLOCK].copy(), 1
    for run, limit in sorted((int(c), int(w)) for c, w in zip(COUNTS[1:], WIDTHS[1:], strict=True) if c > 1):
        for k in range(reach, run):
            np.maximum(widest, width[:, k:k + BLOCK], out=widest)
        reach = run
        best[widest <= limit] = run
    best = best.reshape(-1)
    starts, at = [], np.arange(n_blocks) * BLOCK
    ends = np.minimum(at + BLOCK, len(ids))
    while len(at):
        starts.append(at)
        at = at + best[at]
        more = at < ends
        at, ends = at[more], ends[more]
    if not starts:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32), np.empty(0, np.uint64)
    start = np.sort(np.concatenate(starts))
    count, owner = best[start], start // BLOCK
    escaped = (count == 1) & (ids[start] >= np.uint64(1 << 60))
    words = np.zeros(len(start), np.uint64)
    for run, selector in _SELECTOR.items():
        rows = np.flatnonzero((count == run) & ~escaped)
        word = np.full(len(rows), selector << 60, np.uint64)
        if WIDTHS[selector]:
            for k in range(run):
                word |= ids[start[rows] + k] << np.uint64(k * WIDTHS[selector])
        words[rows] = word
    words[escaped] = np.arange(escaped.sum(), dtype=np.uint64)
    offsets = np.searchsorted(owner, np.arange(n_blocks + 1)).astype(np.uint32)
    return words, offsets, ids[start[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of any run of whole words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == 0:
            out[begin[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif WIDTHS[s]:
            shift = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
            out[begin[rows][:, None] + np.arange(COUNTS[s])] = (words[rows][:, None] >> shift) & np.uint64((1 << int(WIDTHS[s])) - 1)
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, block: int) -> np.ndarray:
    return decode(words[offsets[block]:offsets[block + 1]], escapes)


class _Slots(dict):
    """Numbers pieces as they come; ``new`` lists those not seen before."""

    def __init__(self, owner: PieceTokens):
        super().__init__()
        self.owner, self.new = owner, []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        slot = self[piece] = self.owner.n_slots
        self.owner.n_slots += 1
        return slot


class PieceTokens:
    """Token ids of texts; equal pieces are tokenised once, as far as they are remembered.

    A text is cut around the tokens added to the vocabulary, which have ids of their own
    wherever their literal stands, and before each space that something other than white space follows.
    The vocabulary's own splitting rule always breaks there, so the ids of the pieces,
    one after the other, are those of the text. New pieces are tokenised together; as
    each id stands for a known number of bytes, the ids are dealt out by bytes.
    """

    LIMIT = 800_000
    TOGETHER = 4096
    _odd = re.compile(r" (?!\S)")
    _cut = re.compile(r"(?= \S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("(" + "|".join(re.escape(x.content) for x in sorted(added, key=lambda x: -len(x.content))) + ")") if added else None
        # added tokens that look at their surroundings or at changed text: such texts are not cut
        self.plain = not any(x.lstrip or x.rstrip or x.single_word or re.search(r"\s", x.content) for x in added)
        self.hidden = self.tokenizer.normalizer is not None and any(x.normalized for x in added)
        self.together = 1 if any(re.search(r"\s", x.content) for x in added) else self.TOGETHER
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.n_slots = 0
        self.heads, self.tails = _Slots(self), _Slots(self)  # at a text's start, and after a space
        self.starts, self.lengths, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _cut_up(self, text: str) -> list[int]:
        if self.hidden:
            return [self.heads[text]] if text else []
        if self.added is None or not self.added.search(text):
            return self._cut_at_spaces(text)
        if not self.plain:
            return [self.heads[text]]
        # every second part is an added token
        parts = self.added.split(text)
        return [slot for k, x in enumerate(parts) for slot in ([self.heads[x]] if k % 2 else self._cut_at_spaces(x))]

    def _cut_at_spaces(self, text: str) -> list[int]:
        if self._odd.search(text):
            first, *rest = self._cut.split(text)
            if not first and rest:  # the text starts with a space and a word
                return [self.tails[x[1:]] for x in rest]
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
        return ([self.heads[first]] if first else []) + list(map(self.tails.__getitem__, rest))

    def _store(self, slots: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        for name, need in (("starts", self.n_slots), ("lengths", self.n_slots), ("ids", self.used + len(ids))):
            if need > len(held := getattr(self, name)):
                setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
        self.starts[slots] = self.used + np.cumsum(sizes) - sizes
        self.lengths[slots] = sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        if self.heads.new:
            coded = [x.ids for x in self.tokenizer.encode_batch_fast(self.heads.new, add_special_tokens=False)]
            self._store(np.array([self.heads[x] for x in self.heads.new]), np.array(list(map(len, coded))), np.array([i for x in coded for i in x], np.uint32))
            self.heads.new = []
        for at in range(0, len(self.tails.new), self.together):
            new = self.tails.new[at:at + self.together]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(np.fromiter((len(x.encode()) + 1 for x in new), np.int64, len(new)))
            reached = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(reached, ends) + 1
            if len(ids) != last[-1] or (reached[last - 1] != ends).any():
                raise ValueError("the vocabulary does not break before spaces")
            self._store(np.fromiter(map(self.tails.__getitem__, new), np.int64, len(new)), np.diff(np.concatenate([[0], last])), ids)
        self.tails.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), END_ID after each text."""
        if self.n_slots > self.LIMIT:
            self._forget()
        cut = [np.array(self._cut_up(x), np.int64) for x in texts]
        self._learn()
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        slot = np.concatenate(cut) if cut else np.empty(0, np.int64)
        # each text's end is one more piece, of one id
        ends = np.cumsum(counts + 1) - 1
        start, size = np.zeros(len(slot) + len(cut), np.int64), np.ones(len(slot) + len(cut), np.int64)
        inner = np.ones(len(start), bool)
        inner[ends] = False
        start[inner], size[inner] = self.starts[slot], self.lengths[slot]
        before = np.cumsum(size) - size
        index = np.arange(int(size.sum())) - np.repeat(before - start, size)
        ids = self.ids[index]
        ids[before[ends]] = END_ID
        return ids, np.diff(np.concatenate([[0], before[ends] + 1]))


_TOKENS: dict[str, PieceTokens] = {}


def tokens_of(path: str | None) -> PieceTokens:
    """The tokenizer of a worker, read once; the default file comes with the public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _TOKENS:
        _TOKENS[path] = PieceTokens(path)
    return _TOKENS[path]


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> None:
    """Write the token files of all rows in ascending doc_id order (null first).

    A null text is empty and gives the end id alone. Repeated rows are coded each time.
    Rows of one doc_id are ordered by their text's hash. Other columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, tokens, first = TaskContext.get().partitionId(), tokens_of(tokenizer), 0
        for page, part in enumerate(slices(batches)):
            ids, lengths = tokens.encode([x or "" for x in part.column("text").to_pylist()])
            words, offsets, escapes = encode(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([first], pa.int64()),
                pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (words, offsets, escapes))],
                ["shard", "page", "first", "doc_ids", "lengths", "words", "offsets", "escapes"])
            first += int(lengths.sum())
        give_back()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    (source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PAGE_SCHEMA)
     .write.option("compression", "zstd").parquet(path))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, all from decoded ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(len(batch))):
                ids = decode(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["escapes"], np.uint64)).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                if len(ids) != ends[-1]:
                    raise ValueError(f"shard {row['shard']}, page {row['page']}: {len(ids)} ids, {ends[-1]} expected")
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(crc), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                                                  pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                                                 ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    pages = spark.read.schema(PAGE_SCHEMA).parquet(path)
    # one row per shard: as many as the files have partitions
    totals = pages.groupBy("shard").agg(F.max(F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = totals.select("shard", (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    docs = pages.select("shard", "first", "page", "doc_ids", "lengths", "words", "escapes").mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the files into the shared folder and return what reading them back gives."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, doc_id, text, tokenizer)
    return read_digests(docs.sparkSession, path)
