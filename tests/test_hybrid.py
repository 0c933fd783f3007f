"""Hybrid search against lists fused and checked in plain Python, with nothing cut or merged."""

import random
from collections import defaultdict

import pytest

from railweave.functions.runtime import scratch_path
from railweave.operators import postings as po
from railweave.operators import retrieve as rt
from railweave.operators import search as se
from railweave.operators import stations as st
from railweave.operators import vector_index as vi
from railweave.operators import vectors as vc

NAMES = {"ALP": "Alphaville", "BRV": "Bravotown", "CHR": "Charliebad", "DLT": "Deltaport", "ECH": "Echohausen"}
DOCS = "doc_id long, collection string, source_type string, content string, train_no string, station_code string"
SAME_START = "This beginning is shared by very many documents and it is longer than one hundred characters, so that prefixes tell nothing. "


def documents():
    """Routes with long ties and shared beginnings, nine documents of one number, copies with other numbers."""
    rng, rows = random.Random(3), []
    for k in range(120):
        stops = rng.sample(list(NAMES), rng.randint(2, 5))
        rows.append((3000 + k, "train_routes", "train_route", f"{SAME_START if k % 2 else ''}From {stops[0]} to {stops[-1]}. Stops (5): {' > '.join(stops)}.", f"{10000 + k % 40}", None))
    for k in range(60):
        number = "10007" if k < 9 else f"{10000 + k}"
        rows.append((1000 + k, "trains", "train", f"{SAME_START}Train {number} runs, note {k % 30}.", number, None))
    # the same text for two stations: one may be dropped, the other not
    rows += [(2000 + i, "stations", "station", f"Station of {name} and {code}. {SAME_START}", None, code) for i, (code, name) in enumerate(NAMES.items())]
    rows += [(2100 + i, "stations", "station", "Station Alphaville ALP and Bravotown BRV share this text.", None, code) for i, code in enumerate(("ALP", "BRV", "CHR"))]
    rows += [(4000 + k, "railway_rules", "rule", f"{SAME_START}Luggage rule {k % 7} about refund and penalty.", None, None) for k in range(40)]
    return rows


QUESTIONS = [
    (1, "Where is train 10007 now?"), (2, "Trains from Alphaville to Bravotown"), (3, "which trains go from deltaport to Echohausen"), (4, "Tell me about Charliebad station"),
    (5, "luggage rule and refund"), (6, "Does 10007 go from Bravotown to Charliebad"), (7, "trains 10007 and 10011 at Alphaville"), (8, "nothing of the kind"), (9, "Trains from Alphaville to Bravotown"), (10, None),
]


def brute(spark, docs, hits, asked, near, top_k, limit):
    by = {r[0]: dict(zip(("doc_id", "collection", "source_type", "content", "train_no", "station_code"), r, strict=True)) for r in docs}
    lists = defaultdict(list)
    for h in hits:
        if h.same_case:
            lists[h.code, h.collection, h.term_no].append((h.doc_id, h.score))
    out = []
    for q in asked:
        entries = []
        numbers = __import__("re").findall(r"\b(\d{5})\b", q.question)
        found = [d for c in ("trains", "train_routes") for n in numbers for d in sorted(by) if by[d]["collection"] == c and by[d]["train_no"] == n]
        entries += [(0, rank, d, 1.0) for rank, d in enumerate(found)]
        rank = 0
        for s in q.stations:
            for c in ("stations", "train_routes"):
                for term in (0, 1):
                    for d, score in sorted(lists[s.code, c, term]) if c in q.active else ():
                        entries.append((1, rank, d, score))
                        rank += 1
        best = sorted((-n.score, n.collection, n.doc_id) for n in near if n.question_id == q.question_id and n.collection in q.active)[:top_k]
        entries += [(2, rank, d, -s) for rank, (s, _, d) in enumerate(best)]
        groups = defaultdict(list)
        for e in entries:
            groups[tuple(by[e[2]][c] for c in ("content", "collection", "source_type", "train_no", "station_code"))].append(e)
        names = [(s.name.lower(), s.code.lower()) for s in q.stations]

        def valid(d):
            if d["source_type"] != "train_route" or len(names) < 2:
                return None
            text = d["content"].lower()
            stops = text.split("stops")[1].split(">")
            at = [[i for i, x in enumerate(stops) if n in x or c in x] for n, c in names[:2]]
            return all(n in text or c in text for n, c in names[:2]) and not (at[0] and at[1] and at[0][0] >= at[1][0])

        kept = []
        for es in groups.values():
            doc, score = max((e[3], -e[0], -e[1], e[2]) for e in es)[3], max(e[3] for e in es)
            ok = valid(by[doc])
            if ok is not False:
                kept.append((not ok, -round(sum(1 / (61 + e[1]) for e in es), 12), min(e[:3] for e in es), doc, score))
        own = {by[k[3]]["train_no"] for k in kept if not k[0]}
        kept = [k for k in kept if not (own and by[k[3]]["collection"] == "trains" and by[k[3]]["train_no"] not in own)]
        codes = {s.code for s in q.stations}
        kept = [k for k in kept if not (codes and by[k[3]]["source_type"] == "station" and by[k[3]]["station_code"] not in codes)]
        n = limit if q.stations or found else top_k
        out += [(q.question_id, p, k[3], k[4], round(-k[1], 6)) for p, k in enumerate(sorted(kept)[:n], 1)]
    return out


@pytest.mark.parametrize("limit", [25, None])
def test_whole_results_equal_brute_force(spark, limit):
    rows = documents()
    docs = vc.hashed_embedding(spark.createDataFrame(rows, DOCS))
    dim = st.station_dim(*station_tables(spark))
    aliases = st.alias_index(dim)
    questions = spark.createDataFrame(QUESTIONS, "question_id long, question string")
    got = sorted((r.question_id, r.position, r.doc_id, r.score, r.rrf_score) for r in se.hybrid_search(questions, docs, dim, aliases, limit=limit).collect())
    asked = questions.where("question IS NOT NULL")
    prepared = rt.rewrite_query(se.resolve_stations(rt.expand_synonyms(asked), aliases, dim)).withColumn("active", rt.route_collections("expanded"))
    near = vc.vector_topk(vc.hashed_embedding(prepared.select("question_id", "search_text"), "search_text"), docs).collect()
    hits = rt.keyword_join(docs, dim, any_case=True).collect()
    want = sorted(brute(spark, rows, hits, prepared.collect(), near, 10, limit))
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == w[3] and abs(g[4] - w[4]) < 1.5e-6 for g, w in zip(got, want, strict=True))
    if limit is None:
        of = defaultdict(set)
        for q, _, d, *_ in got:
            of[q].add(d)
        assert set(range(1000, 1009)) <= of[1] and len(of[2]) > 25 and of[2] == of[9]


def test_stored_indexes_give_the_same_results(spark):
    """Keyword hits from stored postings and vectors from an index whose cells are all probed."""
    docs = vc.hashed_embedding(spark.createDataFrame(documents(), DOCS))
    dim = st.station_dim(*station_tables(spark))
    aliases = st.alias_index(dim)
    questions = spark.createDataFrame(QUESTIONS, "question_id long, question string")
    at = scratch_path(spark, "indexes")
    po.write_postings(rt.keyword_join(docs, dim, any_case=True), f"{at}/postings")
    model = vi.fit_index(docs)
    vi.build_index(docs, model, f"{at}/vectors")
    near = lambda q: vi.indexed_topk(q, vi.read_index(spark, f"{at}/vectors"), model, probes=10**6, survivors=10**6)
    found = se.hybrid_search(questions, docs, dim, aliases, keyword_hits=po.postings(po.read_postings(spark, f"{at}/postings")), nearest=near)
    rows = lambda df: sorted((r.question_id, r.position, r.doc_id, r.rrf_score) for r in df.collect())
    assert rows(found) == rows(se.hybrid_search(questions, docs, dim, aliases))


def station_tables(spark):
    info = spark.createDataFrame([(i, code, name, "city", "1", "1", "0") for i, (code, name) in enumerate(NAMES.items())], "row_id long, station_code string, title string, city string, lat string, lng string, wifi_station string")
    zones = spark.createDataFrame([(i, code, name, "Z", "Zone") for i, (code, name) in enumerate(NAMES.items())], "row_id long, station_code string, station_name string, zone string, zone_name string")
    aka = spark.createDataFrame([], "row_id long, station_code string, title string")
    return info, zones, aka
