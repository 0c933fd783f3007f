"""Targets against step-wise sharing; copies against the sums they have to keep."""

import pytest
from llm_texts import WORD, prose

from railweave.llm import mixing


def brute_targets(sizes):
    """sizes: words per source. Shares by weight, cut at three times, shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    for _ in range(200):
        over = sum(max(0, target[s] - 3 * sizes[s]) for s in order)
        free = [s for s in order if target[s] < 3 * sizes[s]]
        target = {s: min(target[s], 3 * sizes[s]) for s in order}
        if over < 1e-9 or not free:
            break
        for s in free:
            target[s] += over * weight[s] / sum(weight[f] for f in free)
    return target


def check(make, rows, **options):
    got = mixing.copies(make(rows), **options).collect()
    sizes, largest = {}, {}
    for _, text, _, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    target = brute_targets(sizes)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((d, len(WORD.findall(t or ""))) for d, t, _, _ in rows), key=str)
    source_of = {}
    for d, _, _, s in rows:
        source_of.setdefault(d, set()).add(s)
    for r in got:
        matching = [s for s in source_of[r.doc_id] if r.source_size == sizes[s]]
        assert matching and any(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) for s in matching)
        low = int(r.target / r.source_size + 1e-9) if r.source_size else 0
        assert r.copies in (low, low + 1) and r.copies <= 3
    unique = {d: s for d, ss in source_of.items() if len(ss) == 1 for s in ss}
    for s in sizes:
        mine = [r for r in got if unique.get(r.doc_id, "?") == s]
        if all(d in unique for d, _, _, x in rows if x == s):
            assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= largest[s] / 2 + 1e-6
    return got


def rows_of(n_sources, n, seed=0):
    import random
    rng = random.Random(seed)
    words = prose(seed, 300)
    return [(k, " ".join(words[:rng.randint(1, 200)]), "a", rng.choices([f"s{j}" for j in range(n_sources)], [8, *[1] * (n_sources - 1)])[0]) for k in range(n)]


@pytest.mark.parametrize("fan_in", [4, 128])
def test_sums(make, fan_in):
    rows = rows_of(5, 400)
    first = check(make, rows, fan_in=fan_in)
    again = mixing.copies(make(rows[::-1]), fan_in=fan_in).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_odd_rows(make, odd_rows):
    check(make, odd_rows)


def test_small_sources_stop_at_three_times(make):
    rows = [(1, "a b", "x", "s1"), (2, "c", "x", "s2"), *((k, "w " * 50, "x", "s3") for k in range(3, 40))]
    got = {r.doc_id: r for r in check(make, rows)}
    assert got[1].copies == 3 and got[2].copies == 3


def test_code_points_and_null(make):
    check(make, [(1, "a b c", "x", "é"), (2, "a b", "x", "z"), (3, "a b c d", "x", None), (4, "a", "x", "Z")])


def test_equal_rows_in_one_table(make):
    rows = [(7, "same row here", "x", "s1")] * 300 + [(8, "w " * 40, "x", "s2")] * 3
    got = mixing.copies(make(rows), fan_in=8).collect()
    assert len(got) == 303 and abs(sum(r.copies * r.size for r in got if r.doc_id == 7) - next(r.target for r in got if r.doc_id == 7)) <= 1.5


def test_mix_repeats_whole_rows(make, odd_rows):
    docs = make(odd_rows)
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns
    copies = sum(r.copies for r in mixing.copies(docs).collect())
    assert taken.count() == copies


def test_empty_table(make):
    assert mixing.copies(make([])).collect() == [] and mixing.mix(make([])).collect() == []
    assert [r.copies for r in mixing.copies(make([(1, None, None, None)])).collect()] == [0]


def test_words_like_the_contract(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0c\rd\n", "é\xa0b c", "x" * 10, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.words(mixing.F.col("text"))).collect()]
    assert got == [len(WORD.findall(t or "")) for t in texts]
