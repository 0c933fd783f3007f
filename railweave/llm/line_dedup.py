"""Line dedup by range-partitioned hashes.

Every line's hash is sorted together with its document and position, over ranges that
may cut through the lines of one hash, however common it is. A pass over each range
streams the first occurrences; what a range cannot decide alone, its first hash, is
settled with one row per range. The result is a compressed bitmap of the lines to keep
per document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.functions.runtime import materialise
from railweave.llm.common import scan

#: Shorter keys, in code points, never lose a line.
MIN_CHARS = 10
SPACE = " \t\n\x0b\x0c\r"
#: no_id: the document has no doc_id; did: its doc_id, else its text's hash.
_DOC = "no_id boolean, did long, t1 long"
_LINE_SCHEMA = f"h1 long, h2 long, {_DOC}, line_no int"
LOCAL, OPEN, LAST = 0, 1, 2


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    identity, digest = F.col(doc_id).cast("long"), F.xxhash64(F.col(text))
    return docs.select(identity.alias("doc_id"), identity.isNull().alias("no_id"), F.coalesce(identity, digest).alias("did"), digest.alias("t1"), F.col(text).alias("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key is long enough: 128-bit hash, document, position."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        digests, rows, numbers = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for number, line in enumerate(text.split("\n") if text else ()):
                key = line.strip(SPACE)
                if len(key) >= min_chars:
                    digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                    rows.append(row)
                    numbers.append(number)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        taken = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                                           *(batch.column(c).take(taken) for c in ("no_id", "did", "t1")), pa.array(numbers, pa.int32())],
                                          ["h1", "h2", "no_id", "did", "t1", "line_no"])

    return scan(docs.select("no_id", "did", "t1", "text"), run, _LINE_SCHEMA)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one range, in order, reduced to those to drop and to what is open.

    LOCAL: a line to drop. OPEN: a line of the range's first hash, which may have begun
    in a range before. LAST: the first line of the range's last hash.
    """
    key, owner, first, last = None, None, True, None
    for batch in batches:
        if not len(batch):
            continue
        h1, h2, no_id, did = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "no_id", "did"))
        fresh = np.ones(len(h1), bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = key == (h1[0], h2[0])
        if goes_on:
            fresh[0] = False
        elif key is not None:
            first = False
        begin = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1  # -1: the hash carried over
        own_no, own_did = no_id[begin], did[begin]
        if goes_on:
            own_no, own_did, group = np.concatenate([[owner[0]], own_no]), np.concatenate([[owner[1]], own_did]), group + 1
        drop = (no_id != own_no[group]) | (did != own_did[group])
        open_rows = group == 0 if first else np.zeros(len(h1), bool)
        chosen = np.flatnonzero(drop | open_rows)
        if len(chosen):
            part = batch.take(pa.array(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(open_rows[chosen], OPEN, LOCAL).astype(np.int32)), *(part.column(c) for c in ("h1", "h2", "no_id", "did", "t1", "line_no"))],
                                             ["kind", "h1", "h2", "no_id", "did", "t1", "line_no"])
        if len(begin):
            last = batch.slice(int(begin[-1]), 1)
        if len(begin) > (0 if goes_on else 1):
            first = False
        key, owner = (h1[-1], h2[-1]), (own_no[group[-1]], own_did[group[-1]])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([LAST], pa.int32()), *(last.column(c) for c in ("h1", "h2", "no_id", "did", "t1", "line_no"))],
                                         ["kind", "h1", "h2", "no_id", "did", "t1", "line_no"])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(no_id, did, t1, line_no) of all lines but those of the first document of each key."""
    lines = materialise(line_hashes(docs, min_chars), "lines")
    order = ["h1", "h2", "no_id", "did", "line_no"]
    streamed = materialise(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, f"kind int, {_LINE_SCHEMA}"), "streamed")
    local = streamed.filter(F.col("kind") == LOCAL)
    # at most two hashes per range
    doc = F.struct("no_id", "did")
    owners = streamed.filter(F.col("kind") != LOCAL).groupBy("h1", "h2").agg(F.min(doc).alias("owner"))
    rest = streamed.filter(F.col("kind") == OPEN).join(F.broadcast(owners), ["h1", "h2"]).filter(doc != F.col("owner"))
    return local.select("no_id", "did", "t1", "line_no").unionByName(rest.select("no_id", "did", "t1", "line_no"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: doc_id, no_id, did, t1 (the row's identity), n_lines, n_dropped, keep.

    keep: zlib-compressed bits of the lines to keep, first line first. A line's key is
    the line without white space at its ends, A-Z lower-cased. Null and empty texts
    have one empty line, which stays. Rows that repeat a doc_id are one document; a row
    without doc_id is a document of its own text that comes after all others. Other
    columns are ignored.
    """
    return _bitmaps(_identified(docs, doc_id, text), min_chars)


def _bitmaps(source: DataFrame, min_chars: int) -> DataFrame:
    drops = dropped_lines(source, min_chars).groupBy("no_id", "did", "t1").agg(F.collect_set("line_no").alias("drops"))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(1))
    narrow = source.select("doc_id", "no_id", "did", "t1", F.when(F.col("text").isNull(), 1).otherwise(n_lines).cast("long").alias("n_lines"))

    def pack(batches):
        for batch in batches:
            bitmaps, counts = [], []
            for n, drops in zip(batch.column("n_lines").to_pylist(), batch.column("drops").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[drops or []] = False
                counts.append(n - int(keep.sum()))
                bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "no_id", "did", "t1", "n_lines")), pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary())],
                                             ["doc_id", "no_id", "did", "t1", "n_lines", "n_dropped", "keep"])

    return (narrow.join(drops, ["no_id", "did", "t1"], "left").select("doc_id", "no_id", "did", "t1", "n_lines", "drops")
            .mapInArrow(pack, f"doc_id long, {_DOC}, n_lines long, n_dropped long, keep binary"))


def kept_text(text: str | None, keep: bytes, n_lines: int) -> str:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines)
    return "\n".join(line for line, bit in zip((text or "").split("\n"), bits, strict=True) if bit)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and the kept text (``digest``: its SHA-256 instead)."""
    source = _identified(docs, doc_id, text)
    bitmaps = _bitmaps(source, min_chars).drop("doc_id").distinct()
    joined = source.join(bitmaps, ["no_id", "did", "t1"]).select("doc_id", "n_lines", "n_dropped", "keep", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [kept_text(t, k, n) for t, k, n in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), batch.column("n_lines").to_pylist(), strict=True)]
        if digest:
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(texts, pa.string())],
                                          ["doc_id", "n_lines", "n_dropped", "kept"])

    return scan(joined, run, "doc_id long, n_lines long, n_dropped long, kept string")
