"""Substring dedup by hashing lines, paragraphs and their parts.

A line is cut into units behind clause marks; a unit that is still long is cut behind
words that their own hash picks, so equal passages are cut alike wherever they stand.
Units are compared by the hash of their lower-cased words. Grouped over all documents, each
hash belongs to the document that ranks first, and a unit is a repeat anywhere else, or
when it comes again in that document. Runs of repeated units with enough words are
removed; the spans keep the offsets of the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.functions.runtime import materialise
from railweave.llm.common import mix64, scan, word_hashes

#: A run of repeated units is removed from this many words on. A passage of 50 words has partial units at its ends.
MIN_WORDS = 40
#: Units over LONG words are cut behind every word whose hash leaves 0 by CUT, on average.
LONG, CUT = 12, 4
MARKS = ".,;:!?|"
#: Rank of documents without doc_id: behind all others.
LAST = (1 << 63) - 1

_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def units(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, words) of the units of a whole text; none for null or blank."""
    coded = (text or "").encode()
    start, hashes = word_hashes(coded.lower())
    n = len(start)
    if not n:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    data = np.frombuffer(coded, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1  # ends of words
    line = np.cumsum(data == 10)
    last = _MARK[data[edge - 1]]
    last[:-1] |= line[start[1:]] != line[start[:-1]]
    last[-1] = True
    piece = np.cumsum(np.concatenate([[0], last[:-1]]))
    long = np.bincount(piece)[piece] > LONG
    last |= long & ((hashes >> np.uint64(7)) % np.uint64(CUT) == 0)
    ends = np.flatnonzero(last)
    begins = np.concatenate([[0], ends[:-1] + 1])
    words = ends - begins + 1
    # words of a unit weigh by their place in it
    place = (np.arange(n) - np.repeat(begins, words)).astype(np.uint64)
    total = np.add.reduceat(mix64(hashes + place * _BASE), begins)
    return mix64(total + words.astype(np.uint64)), start[begins], edge[ends], words


def _runs(flags: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(words)])
    return [(int(a), int(b) - 1) for a, b in zip(edge[0::2], edge[1::2], strict=True) if total[b] - total[a] >= min_words]


def repeated_runs(known: dict[int, int], hashes: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int, int | None]]:
    """(first unit, last unit, words, owner) of runs of repeated units, not overlapping.

    known: owners of hashes that an earlier document has. A run repeats earlier documents
    throughout or the document itself throughout; such runs that overlap are joined.
    owner: the earlier document of the longest unit; null if only the document itself is repeated.
    """
    owners = [known.get(h) for h in hashes.tolist()]
    within = np.ones(len(hashes), bool)
    within[np.unique(hashes, return_index=True)[1]] = False
    found = [(*r, True) for r in _runs(np.array([x is not None for x in owners], bool), words, min_words)] + [(*r, False) for r in _runs(within, words, min_words)]
    out: list[list] = []
    for a, b, other in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][2] = max(b, out[-1][1]), out[-1][2] or other
        else:
            out.append([a, b, other])

    def owner(a: int, b: int) -> int | None:
        return max((int(words[k]), -k, owners[k]) for k in range(a, b + 1) if owners[k] is not None)[2]

    return [(a, b, int(words[a:b + 1].sum()), owner(a, b) if other else None) for a, b, other in out]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row per span to remove: doc_id, start, end (characters of the text), n_words, first_doc_id.

    Documents rank by doc_id; rows that repeat a doc_id are one document, rows without it
    share the last rank. first_doc_id: an earlier document with the passage, the
    document itself for repeats within it. Null, empty and blank texts have no units,
    an empty table no spans. Other columns are ignored.
    """
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("rank"), F.col(text).alias("text"))

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(units(x)[0]) for x in batch.column("text").to_pylist()]
        rank = np.repeat(batch.column("rank").to_numpy(), [len(x) for x in found])
        flat = np.concatenate(found) if found else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(rank)], ["h", "rank"])

    emitted = scan(source, emit, "h long, rank long")
    owners = emitted.groupBy("h").agg(F.min("rank").alias("owner"), F.max("rank").alias("top")).filter("owner < top").select("h", "owner")
    known = emitted.join(owners, "h").filter("owner < rank").groupBy("rank").agg(F.collect_set(F.struct("h", "owner")).alias("known"))
    known = materialise(known, "known")
    return _spans(source.join(known, "rank", "left").select("rank", "known", "text"), min_words)


def _spans(joined: DataFrame, min_words: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in range(5)]
        for rank, known, text in zip(*(batch.column(c).to_pylist() for c in ("rank", "known", "text")), strict=True):
            hashes, start, end, words = units(text)
            owners = {x["h"]: x["owner"] for x in known or ()}
            runs = repeated_runs(owners, hashes.view(np.int64), words, min_words) if owners or len(np.unique(hashes)) < len(hashes) else ()
            if not runs:
                continue
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
            own = None if rank == LAST else rank
            for a, b, n, owner in runs:
                for column, value in zip(out, (own, int(chars[start[a]]), int(chars[end[b]]), n, own if owner is None else owner), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "end", "n_words", "first_doc_id"])

    return scan(joined, run, "doc_id long, start long, end long, n_words long, first_doc_id long")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which do not overlap."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])
