"""Losses against models counted in plain Python."""

import math
import random
import statistics
from collections import Counter

import pytest
from llm_texts import WORD, prose

from railweave.llm import lm_scoring as lm


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, wanted, prior, corpus=None):
    """Each text against counts over all other distinct texts of the corpus, both models walked word by word."""
    corpus = rows if corpus is None else corpus
    texts = {t: any(d in wanted for d, x in corpus if x == t) for _, t in corpus if t is not None}
    size = len({w for t in texts for w in words_of(t)}) + 2
    out = []
    for d, t in rows:
        w, losses = words_of(t), []
        for k in (0, 1):
            pairs, single, before = Counter(), Counter(), Counter()
            for other, good in texts.items():
                if other != t and (good or not k):
                    seq = words_of(other)
                    pairs.update(zip(["<s>", *seq], seq))
                    before.update(["<s>", *seq][:len(seq)])
                    single.update(seq)
            every = sum(single.values()) + size
            loss = -sum(math.log((pairs[a, b] + prior * (single[b] + 1) / every) / (before[a] + prior)) for a, b in zip(["<s>", *w], w))
            losses.append(loss / len(w) if w else None)
        out.append((d, len(w), losses[1], losses[0]))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        if w[1]:
            assert abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9 and abs(g[4] - (w[2] - w[3])) < 1e-9
        else:
            assert g[2] is g[3] is g[4] is None


def test_target_like_texts_score_lower(spark, make):
    a, b = prose(81, 40), prose(82, 40)
    rows = [(k, " ".join((a if k % 2 else b)[(k * j) % 40] for j in range(50))) for k in range(1, 200)]
    docs = make(rows)
    got = {r.doc_id: r.score for r in lm.score(docs, lm.fit(docs, spark.createDataFrame([(k,) for k in range(1, 100, 2)], "doc_id long"))).collect()}
    assert max(got[k] for k in range(101, 199, 2)) < min(got[k] for k in range(100, 199, 2))


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "doc_id long")
    assert lm.score(make([]), lm.fit(make([]), none)).collect() == []
    docs = make([(1, "a b c")])
    assert lm.score(docs, lm.fit(docs, none)).first().n_words == 3


def test_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows)
    assert lm.score(docs, lm.fit(docs, spark.createDataFrame([(1,)], "doc_id long"))).count() == len(odd_rows)


@pytest.mark.parametrize("hot_words, hot_pairs, group", [(2e-5, 2.5e-6, lm.GROUP), (0.004, 0.002, lm.GROUP), (2.0, 2.0, lm.GROUP), (2.0, 0.002, 40)])
def test_losses_without_the_text_itself(spark, make, hot_words, hot_pairs, group):
    """However the work is dealt out; copies are one text, wanted if one of them is; also for texts that were not counted."""
    common = prose(71, 25)
    rows = [(k, " ".join(common[(k * j * j + j) % 25] for j in range(10 + k % 7)) + " " + " ".join(prose(300 + k, 3)).upper()) for k in range(30)]
    rows += [(50, None), (51, ""), (52, "  "), (53, "a"), (None, "no id here"), (None, "no id here"), (1, "repeated id"), (1, "repeated id"), (60, rows[3][1]), (61, rows[20][1]), (5, rows[20][1]), (70, " ".join(common[:2] * 40))]
    wanted = {1, 2, 3, 4, 5, 50}
    docs, target = make(rows), spark.createDataFrame([(x, "x") for x in [*wanted, 1, None, 999]], "doc_id long, text string")
    models = lm.fit(docs, target, prior=7.0, hot_words=hot_words, hot_pairs=hot_pairs, bucket=100, sample=10, group=group)
    same(lm.score(docs, models).collect(), brute(rows, wanted, 7.0))
    others = rows[::4] + [(80, "words of no other text"), (81, " ".join(common)), (81, " ".join(common)), (None, None)]
    same(lm.score(make(others), models).collect(), brute(others, wanted, 7.0, rows))


def test_a_label_does_not_pay(spark, make):
    """Wanted texts and equally good ones without a label differ by less than their own spread."""
    good, bad = prose(91, 300), prose(92, 300)
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(good if k % 2 else bad, k=60))) for k in range(600)]
    wanted = set(range(1, 600, 4))
    docs = make(rows + [(10_000 + k, t) for k, t in rows[1:40:2]])
    got = {r.doc_id: r.score for r in lm.score(docs, lm.fit(docs, spark.createDataFrame([(k,) for k in wanted], "doc_id long"))).collect()}
    named, other, junk = ([got[k] for k in range(600) if test(k)] for test in (lambda k: k in wanted, lambda k: k % 2 and k not in wanted, lambda k: not k % 2))
    assert abs(statistics.mean(named) - statistics.mean(other)) < 0.3 * statistics.pstdev(other)
    assert max(named + other) < min(junk) and all(got[10_000 + k] == got[k] for k in range(1, 40, 2))


def test_most_rows_are_one_text(spark, make):
    rows = [(k, "one text that most rows share") for k in range(3000)] + [(5000 + k, " ".join(prose(k, 12))) for k in range(20)]
    docs = make(rows)
    got = lm.score(docs, lm.fit(docs, spark.createDataFrame([(1,), (5001,)], "doc_id long"))).collect()
    want = brute(rows[:1] + rows[3000:], {0, 5001}, lm.PRIOR, [(0, rows[0][1]), *rows[3000:]])
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id < 3000}) == 1
    same([r for r in got if r.doc_id == 0 or r.doc_id >= 5000], want)


def test_rare_words_of_a_large_corpus_have_counts_of_their_own(spark, make):
    rows = [(k, "the same words again " * (15_000 + k)) for k in range(4)] + [(10, "rare pair"), (11, "a rare pair"), (12, "lone words")]
    docs = make(rows)
    same(lm.score(docs, lm.fit(docs, spark.createDataFrame([(10,)], "doc_id long"))).collect(), brute(rows, {10}, lm.PRIOR))
