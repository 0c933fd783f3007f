"""Windows of benchmark items against a scan of every position."""

import re

import pytest
from llm_texts import lines, prose

from railweave.llm import decontaminate

BENCH = "item_id long, text string, w string, win string, length string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p:p + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, hit, seen = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[p:p + n]))):
                    seen |= found
                    hit |= set(range(p, p + n))
        out.append((doc_id, len(w), len(hit), len(seen), sorted(seen), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items():
    a, b = prose(21, 40), prose(22, 20)
    return [(1, " ".join(a)), (2, " ".join(b)), (30, " ".join(a[5:25])), (4, "Just five short words here"), (5, "solo"), (6, None), (7, " .. "), (None, " ".join(b[:14])),
            (8, "na " * 60), (2, " ".join(prose(23, 13))), (9, "two words"), (10, "Émile É7 x")]


@pytest.fixture(scope="module")
def planted(items):
    a = items[0][1].split()
    return [(100, " ".join(prose(24, 50) + a[3:18] + prose(25, 50))), (101, ", ".join(a).upper()), (102, " ".join(a[:12])), (103, "just FIVE short-words here... solo"), (104, "solo"),
            (105, "na " * 500), (106, "two  words two words"), (107, "émile É7 X"), (108, lines(prose(26, 3000)) + " " + items[1][1]), (100, "na " * 12), (None, items[1][1])]


def run(spark, make, rows, items):
    out = decontaminate.hits(make(rows), spark.createDataFrame([(*x, "x", "x", "x") for x in items], BENCH))
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()), key=str)


def test_against_every_position(spark, make, odd_rows, items, planted):
    rows = [r[:2] for r in odd_rows] + planted
    assert run(spark, make, rows, items) == brute(rows, items)


def test_without_broadcast(spark, make, items, planted, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert run(spark, make, planted, items) == brute(planted, items)


@pytest.mark.parametrize("rows, bench", [([], [(1, "a b c")]), ([(1, "a b c"), (2, None)], []), ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, make, rows, bench):
    assert run(spark, make, rows, bench) == brute(rows, bench)


def test_removal_keeps_columns(spark, make, items, planted):
    docs = make(planted)
    clean = decontaminate.remove_contaminated(docs, spark.createDataFrame([(*x, "x", "x", "x") for x in items], BENCH))
    want = [r[0] for r, b in zip(sorted(planted, key=lambda r: str(r[0])), sorted(planted, key=lambda r: str(r[0])), strict=True) if not brute([b], items)[0][5]]
    assert clean.columns == docs.columns and sorted((r.doc_id for r in clean.collect()), key=str) == sorted(want, key=str)
