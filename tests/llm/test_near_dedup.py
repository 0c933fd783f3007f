"""Near duplicates against all pairs of full sets; sketches against their theory."""

import numpy as np
from llm_texts import WORD, prose

from railweave.llm import near_dedup
from railweave.llm.common import mix64


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()))
    return out


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = sets_of(rows)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    named = [(d, s) for d, s in sets if d is not None]
    for i, (a, s) in enumerate(named):
        find(a)
        for b, t in named[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def run(make, rows):
    out = near_dedup.near_duplicates(make(rows))
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_odd_rows(make, odd_rows):
    assert run(make, odd_rows) == brute([r[:2] for r in odd_rows])


def test_empty_table(make):
    assert run(make, []) == []


def test_group_of_near_copies_beyond_a_block(make, monkeypatch):
    """Copies with growing distance from a base: many pairs lie close to the threshold."""
    rng = np.random.default_rng(3)
    base = prose(9, 120)
    rows = []
    for k in range(160):
        words = list(base)
        for at in rng.choice(120, size=k % 14, replace=False):
            words[at] = f"w{k}x{at}"
        rows.append((k * 3 + 1, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    assert run(make, rows) == brute(rows)


def test_chain_of_links(make):
    words = prose(10, 400)
    rows = [(50 - k, " ".join(words[5 * k:5 * k + 100])) for k in range(40)]
    got = run(make, rows)
    assert got == brute(rows) and len({r[2] for r in got}) < 40


def test_one_of_each_keeps_columns(make, odd_rows):
    docs = make(odd_rows)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    gone = {r[0] for r in brute([r[:2] for r in odd_rows]) if not r[3]}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in odd_rows if r[0] not in gone), key=str)


def test_sketches_merge_and_estimate():
    a, b = mix64(np.arange(1500, dtype=np.uint64)), mix64(np.arange(300, 1800, dtype=np.uint64))
    ra, rb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.merge_registers(ra, rb) == near_dedup.registers(np.union1d(a, b))).all()
    estimate = near_dedup.joint_estimate(ra[None], rb[None], np.array([1500.0]), np.array([1500.0]))[0]
    assert abs(estimate - 1200 / 1800) < 0.15


def test_block_links_join_components_only():
    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(200, 300, dtype=np.uint64)]
    regs = np.stack([near_dedup.registers(mix64(s)) for s in sets])
    shared = np.intersect1d(*near_dedup.band_hashes(regs[:2]))
    every = np.ones(3, bool)
    links = [x for bucket in shared for x in near_dedup._block_links(int(bucket), np.array([1, 2, 3]), np.array([1, 2, 3]), regs, sets, every, every)]
    assert set(links) <= {(1, 2)} and links
