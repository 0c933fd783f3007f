"""Manifests against trees built in plain Python."""

import hashlib
import zlib

import pytest
from llm_texts import prose

from railweave.llm import merkle

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc, text, lang, source, n = row
    n = n if n is None else n + more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(hashes, arity):
    """(root, list of each one's siblings by level as (before, after))."""
    paths, rows = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        runs = [list(range(k, min(k + arity, len(hashes)))) for k in range(0, len(hashes), arity)]
        for run in runs:
            for at in run:
                for leaf_no in rows[at]:
                    paths[leaf_no].append(([hashes[x] for x in run if x < at], [hashes[x] for x in run if x > at]))
        hashes, rows = [h(*(hashes[x] for x in run)) for run in runs], [sum((rows[x] for x in run), []) for run in runs]
    return hashes[0], paths


def brute(rows, arity=2):
    groups = {}
    for row in rows:
        groups.setdefault((row[2] is not None, (row[2] or "").encode()), []).append(row)
    keys, subs = sorted(groups), []
    for key in keys:
        groups[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append(climb([leaf(r) for r in groups[key]], arity))
    if not rows:
        return []
    root, upper = climb([s[0] for s in subs], arity)
    out = []
    for key, (subroot, paths), above in zip(keys, subs, upper, strict=True):
        for row, path in zip(groups[key], paths, strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(row, tampered)
            for before, after in path + above:
                folded = h(*before, folded, *after)
            out.append((row[0], leaf(row), subroot, root, h(*(x for step in path + above for side in step for x in side)), folded, folded == root))
    return sorted(out, key=str)


def run(make, rows, **options):
    table = make([r[:4] for r in rows])
    return sorted((tuple(r) for r in merkle.manifest(table, claimed=merkle.check_column(), **options).select(*NAMES).collect()), key=str)


def full(rows):
    """Rows as the fixture stores them: n_chars is the text's length, null without text."""
    rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
    return [(*r[:4], len(r[1]) if r[1] else None) for r in rows]


@pytest.mark.parametrize("arity", [2, 3])
def test_odd_rows(make, odd_rows, arity):
    rows = full(odd_rows)
    got = run(make, rows, arity=arity)
    assert got == brute(rows, arity)
    assert {r[6] for r in got} == {True, False}


def test_sizes_of_groups(make):
    """Groups of one to 65 rows end on different levels, one of them without a name."""
    sizes = {None: 7, "": 1, "-": 2, "a": 3, "é": 8, "b": 9, "c": 65, "d": 1}
    rows = full([(100 * g + k, f"text {k}", name, "s") for g, (name, n) in enumerate(sizes.items()) for k in range(n)])
    assert run(make, rows) == brute(rows)


def test_one_row(make):
    rows = full([(7, "text", None, None)])
    assert run(make, rows) == brute(rows)


def test_one_group_and_one_row_hold_most(spark, make):
    """A group of two thirds, a third of all rows equal in every column, over many ranges."""
    same = (5, "the same row", "a", "s")
    rows = full([(k, " ".join(prose(k, 5)), "a" if k % 3 else f"l{k % 9}", "s") for k in range(900)] + [same] * 450)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(make, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table(make):
    assert run(make, []) == []
