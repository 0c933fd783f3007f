"""Kept lines against a walk over all lines."""

import numpy as np
from llm_texts import prose

from railweave.llm import line_dedup as ld


def brute(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ld.SPACE))

    # a document without id is one by its text, behind all others
    named = [((d is None, d if d is not None else 0, "" if d is not None else t or ""), (t or "").split("\n")) for d, t in rows]
    owner = {}
    for doc, ls in named:
        for line in ls:
            owner[key(line)] = min(owner.get(key(line), doc), doc)
    out = []
    for (d, _), (doc, ls) in zip(rows, named, strict=True):
        kept = [line for line in ls if len(key(line)) < 10 or owner[key(line)] == doc]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(make, rows):
    return sorted((tuple(r) for r in ld.dedup_lines(make(rows)).collect()), key=str)


def test_odd_rows(make, odd_rows):
    rows = [r[:2] for r in odd_rows] + [(20, "  A line of text\nx\nA LINE OF TEXT \t\nshort\n"), (21, "a line of text\nown long line\nown long line"), (22, "a line of text\n\nown long liné")]
    assert run(make, rows) == brute(rows)


def test_hot_line_over_many_ranges(spark, make):
    """One line is in every document and is most of all rows, so it spans ranges."""
    common = " ".join(prose(31, 12))
    rows = [(k, f"{common}\nown line number {k}\n{common}") for k in range(3000, 0, -1)] + [(5000, "the end of it all")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(make, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_bitmaps(make):
    rows = {r.doc_id: r for r in ld.keep_bitmaps(make([(1, "first long line\nx"), (2, "y\nfirst long line\nz")])).collect()}
    assert (rows[2].n_lines, rows[2].n_dropped) == (3, 1) and ld.kept_text("y\nfirst long line\nz", rows[2].keep, 3) == "y\nz"
    assert np.frombuffer(__import__("zlib").decompress(rows[1].keep), np.uint8).tolist() == [0b11000000]


def test_empty_table(make):
    assert run(make, []) == []
