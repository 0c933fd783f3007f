"""Removed spans against a walk over all units in rank order."""

from llm_texts import lines, prose

from railweave.llm import unit_dedup as ud


def brute(rows, min_words=ud.MIN_WORDS):
    ranked = sorted(((ud.LAST if d is None else d, t) for d, t in rows), key=lambda r: r[0])
    owner = {}
    for rank, text in ranked:
        for h in ud.units(text)[0].tolist():
            owner.setdefault(h, rank)
    out = []
    for rank, text in ranked:
        hashes, start, end, words = ud.units(text)
        seen, flags = set(), []
        for h in hashes.tolist():
            flags.append((owner[h] < rank, h in seen))
            seen.add(h)
        marked = [False] * len(flags)
        for kind in (0, 1):
            k = 0
            while k < len(flags):
                j = k
                while j < len(flags) and flags[j][kind]:
                    j += 1
                if sum(words[k:j]) >= min_words:
                    marked[k:j] = [True] * (j - k)
                k = max(j, k + 1)
        raw = (text or "").encode()
        for k, m in enumerate(marked):
            if m:
                out.append((None if rank == ud.LAST else rank, *(len(raw[:x].decode()) for x in (int(start[k]), int(end[k])))))
    return out


def run(make, rows):
    return [tuple(r) for r in ud.repeats(make(rows)).collect()]


def test_marked_units(make, odd_rows):
    rows = [r[:2] for r in odd_rows] + [(40, lines(prose(41, 80)) + "\n" + lines(prose(41, 80)))]
    spans, marked = run(make, rows), brute(rows)
    for doc, start, end in marked:
        assert any(d == doc and a <= start and end <= b for d, a, b, _, _ in spans), (doc, start, end)
    for doc, a, b, _, _ in spans:
        assert any(d == doc and s == a for d, s, _ in marked) and any(d == doc and e == b for d, _, e in marked)
    assert any(r[0] == 40 and r[4] == 40 for r in spans)


def test_passage_in_mid_line_is_found_in_all_but_the_first(make):
    passage = " ".join(prose(51, 60))
    rows = [(k, " ".join(prose(100 + k, 40)) + f" {passage} " + " ".join(prose(200 + k, 40))) for k in range(8)] + [(9, lines(prose(60, 300)))]
    spans = run(make, rows)
    assert {r[0] for r in spans} == set(range(1, 8)) and {r[4] for r in spans} == {0}
    text = dict(rows)
    for doc, a, b, n, _ in spans:
        assert text[doc][a:b] in passage and n >= ud.MIN_WORDS
        assert ud.remove_spans(text[doc], [(a, b)]) == text[doc][:a] + text[doc][b:]


def test_units_of_equal_words_are_equal_anywhere():
    unit = "Ça va très bien"
    assert set(ud.units(f"x. {unit.upper().replace('Ç', 'Ç')}.")[0].tolist()) & set(ud.units(f"{unit.upper()}.\nother")[0].tolist())
    assert ud.units(None)[0].size == ud.units(" \n")[0].size == 0


def test_empty_table(make):
    assert run(make, []) == []
