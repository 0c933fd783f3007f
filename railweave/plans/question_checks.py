"""Check SQL for questions: entities, classification, station mentions, search."""

from __future__ import annotations

from railweave import fixed_values as fv


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def listed(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def pattern_case(column: str, out: int) -> str:
    arms = " ".join(f"WHEN regexp_matches({column}, {q(p)}, 'i') THEN {q(c) if out == 0 else s}" for p, c, s in fv.QUESTION_PATTERNS)
    return f"CASE {arms} END"


def synonyms(column: str) -> str:
    for pattern, expansion in fv.SYNONYMS:
        column = f"regexp_replace({column}, {q(pattern)}, {q(expansion)}, 'gi')"
    return column


def any_contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def hits(words) -> str:
    return (f"list_filter({listed(words)}, lambda k: list_contains(tok, k) OR (contains(k, ' ') AND regexp_matches(low, '\\b' || k || '\\b')))")


COARSE = "CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.COARSE_INTENT.items()) + " END"

VOCABULARY = f"""
    SELECT DISTINCT token FROM (
        SELECT lower(code) AS token FROM {{dim}}
        UNION ALL SELECT token FROM (SELECT unnest(regexp_extract_all(lower(coalesce(name, '') || ' | ' || array_to_string(aka, ' | ')), '\\b[a-zA-Z]{{3,}}\\b')) AS token FROM {{dim}})
                  WHERE token NOT IN {values(fv.VOCABULARY_IGNORE)})""".replace("{{", "{").replace("}}", "}")

CLASSIFY = {
    "ent": f"""
        SELECT question, coalesce(nullif(regexp_extract(question, '\\b(\\d{{5}})\\b', 1), ''),
                                  nullif(regexp_extract(question, '(?i)(?:train|no\\.?|number|#)\\s*(\\d{{4}})\\b', 1), '')) AS train_no,
               nullif(regexp_extract(question, '\\b(\\d{{10}})\\b', 1), '') AS pnr,
               list_filter(regexp_extract_all(question, '\\b([A-Z]{{2,4}})\\b', 1), lambda t: NOT list_contains({listed(fv.STATION_CODE_EXCLUDE)}, t))[1] AS station_code,
               lower(trim(question)) AS low, regexp_extract_all(lower(trim(question)), '\\w+') AS tok
        FROM (SELECT DISTINCT question FROM {{questions}})""".replace("{{", "{").replace("}}", "}"),
    "vocab": VOCABULARY,
    "station_words": f"""
        SELECT DISTINCT question FROM (SELECT question, unnest(regexp_extract_all(low, '\\b[a-zA-Z]{{2,}}\\b')) AS token FROM {{ent}})
        WHERE token NOT IN {values(fv.STATION_STOP_WORDS)} AND token IN (SELECT token FROM {{vocab}})""".replace("{{", "{").replace("}}", "}"),
    "kw": f"""
        SELECT *, {hits(fv.LIVE_KEYWORDS)} AS live, {hits(fv.SCHEDULE_KEYWORDS)} AS sched, {hits(fv.STATIC_KEYWORDS)} AS stat, {hits(fv.ROUTING_KEYWORDS)} AS rout,
               len({hits(fv.GENERAL_KEYWORDS)}) > 0 AS gen, {pattern_case('question', 0)} AS pc, cast({pattern_case('question', 1)} as double) AS ps,
               station_code IS NOT NULL OR question IN (SELECT question FROM {{station_words}}) AS st,
               {any_contains('low', fv.TRAIN_CLASS_WORDS)} AS cls
        FROM {{ent}}""".replace("{{", "{").replace("}}", "}"),
    "scored": """
        SELECT *, least(1.0::double, 0.35::double * len(live)) AS ls, least(1.0::double, 0.3::double * len(sched)) AS ss,
               least(1.0::double, 0.3::double * len(stat) + 0.2::double * len(rout))
                 + CASE WHEN train_no IS NOT NULL AND len(live) = 0 AND len(sched) = 0 AND len(stat) = 0 THEN 0.4::double ELSE 0 END
                 + CASE WHEN st THEN 0.3::double ELSE 0 END + CASE WHEN cls THEN 0.2::double ELSE 0 END AS ts,
               train_no IS NULL AND pnr IS NULL AND NOT st AND len(live) = 0 AND len(stat) = 0 AND len(sched) = 0 AND len(rout) = 0 AND NOT gen AS off
        FROM {kw}""",
    "decided": """
        SELECT *, CASE WHEN off THEN 'OUT_OF_DOMAIN' WHEN ss > ls AND ss > 0.2 THEN 'SCHEDULE_QUERY' WHEN ls > 0.05 AND (ts > 0.05 OR ss > 0.05) THEN 'HYBRID'
                       WHEN ls > ts THEN 'LIVE_STATUS' WHEN ts > 0 OR gen THEN 'GENERAL_INFO' ELSE 'HYBRID' END AS fc,
               CASE WHEN off THEN 1.0 WHEN ss > ls AND ss > 0.2 THEN least(1.0, ss + 0.1::double) WHEN ls > 0.05 AND (ts > 0.05 OR ss > 0.05) THEN least(1.0, (ls + greatest(ts, ss)) / 2)
                    WHEN ls > ts THEN least(1.0, ls) WHEN ts > 0 OR gen THEN least(1.0, greatest(0.5, ts)) ELSE 0.45 END AS fconf
        FROM {scored}""",
    "classified": ("""
        SELECT question, """ + COARSE.replace("{c}", "coalesce(pc, fc)") + """ AS intent, coalesce(pc, fc) AS intent_category, coalesce(ps, round(fconf, 2)) AS confidence,
               CASE WHEN pc IS NOT NULL OR NOT off THEN train_no END AS train_no, CASE WHEN pc IS NOT NULL OR NOT off THEN station_code END AS station_code,
               CASE WHEN pc = 'PNR_STATUS' THEN pnr END AS pnr, coalesce(pc, fc) = 'PNR_STATUS' AS is_pnr,
               CASE WHEN pc IS NOT NULL THEN 'Pattern match → ' || pc WHEN off THEN 'No railway signals found in query'
                    ELSE array_to_string(list_filter([
                        CASE WHEN len(live) > 0 THEN 'Live keywords: [''' || array_to_string(live, ''', ''') || ''']' END,
                        CASE WHEN len(sched) > 0 THEN 'Schedule keywords: [''' || array_to_string(sched, ''', ''') || ''']' END,
                        CASE WHEN len(stat) > 0 THEN 'Static keywords: [''' || array_to_string(stat, ''', ''') || ''']' END,
                        CASE WHEN train_no IS NOT NULL AND len(live) = 0 AND len(sched) = 0 AND len(stat) = 0 THEN 'Train number with no other signals → default to STATIC train info' END,
                        CASE WHEN st THEN 'Station name/code detected → boost STATIC score' END,
                        CASE WHEN cls THEN 'Train classification name detected → boost STATIC' END,
                        CASE WHEN fc = 'HYBRID' AND ls > 0.05 THEN 'Both live and static/schedule signals → HYBRID' END,
                        CASE WHEN fc = 'LIVE_STATUS' AND train_no IS NULL THEN 'LIVE detected but no train number in query' END,
                        CASE WHEN fc = 'HYBRID' AND ls <= 0.05 THEN 'Low confidence → fallback to HYBRID' END], lambda x: x IS NOT NULL), ' ; ') END AS reasons
        FROM {decided}"""),
}


def mentions(base: str, text: str) -> dict[str, str]:
    """CTEs ``cand, greedy, named``: greedy longest-first mentions of the texts in ``base``."""
    return {
        "texts": f"SELECT DISTINCT {text} AS t, lower({text}) AS low FROM {{{base}}}",
        "cand": f"""
            SELECT t, name, code, st, en, row_number() OVER (PARTITION BY t ORDER BY st - en, st, en, name, code) AS k
            FROM (SELECT t, name, code, length(regexp_extract(low, '(?s)^(.*?)\\b' || alias || '\\b', 1)) AS st,
                         length(regexp_extract(low, '(?s)^(.*?)\\b' || alias || '\\b', 1)) + length(alias) AS en
                  FROM {{texts}} JOIN {{alias_all}} ON contains(low, alias) AND length(alias) > 2 AND alias NOT IN {values(fv.MENTION_STOP_WORDS)}
                  WHERE regexp_matches(low, '\\b' || alias || '\\b'))""".replace("{{", "{").replace("}}", "}"),
        "greedy": """
            SELECT t, k, [struct_pack(s := st, e := en, n := name, c := code)] AS acc FROM {cand} WHERE k = 1
            UNION ALL
            SELECT c.t, c.k, CASE WHEN len(list_filter(g.acc, lambda a: c.st < a.e AND c.en > a.s)) > 0 THEN g.acc
                                  ELSE list_append(g.acc, struct_pack(s := c.st, e := c.en, n := c.name, c := c.code)) END
            FROM greedy g JOIN {cand} c ON c.t = g.t AND c.k = g.k + 1""",
        "named": """
            SELECT t, x.n AS name, x.c AS code, min(x.s) AS pos
            FROM (SELECT t, unnest(acc) AS x FROM (SELECT t, arg_max(acc, k) AS acc FROM {greedy} GROUP BY t)) GROUP BY ALL""",
    }


# ------------------------------------------------------------------------- search
_ROUTING = f"""CASE WHEN {any_contains('lower(expanded)', fv.TRANSIT_WORDS)} THEN {listed(fv.TRANSIT_COLLECTIONS)}
                    WHEN {any_contains('lower(expanded)', fv.RULE_WORDS)} THEN {listed(fv.RULE_COLLECTIONS)} ELSE {listed(fv.COLLECTIONS)} END"""


def embedding(base: str, text: str, *ids: str) -> str:
    """Hashed word counts of unit length, 64 dimensions."""
    keys = ", ".join(ids)
    return f"""
        SELECT {keys}, list(c / greatest(norm, 1e-12) ORDER BY dim) AS v
        FROM (SELECT {keys}, dim, cast(coalesce(n, 0) as double) AS c, sqrt(sum(coalesce(n, 0) * coalesce(n, 0)) OVER (PARTITION BY {keys})) AS norm
              FROM (SELECT {keys}, unnest(generate_series(0, 63)) AS dim FROM {{{base}}}) d
              LEFT JOIN (SELECT {keys}, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 AS dim, count(*) AS n
                         FROM (SELECT {keys}, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{Nd}}]+')) AS w FROM {{{base}}}) WHERE w <> '' GROUP BY ALL) h
              USING ({keys}, dim))
        GROUP BY {keys}""".replace("\\p{{", "\\p{").replace("L}}", "L}").replace("Nd}}", "Nd}")


STATION_TERMS = """
    SELECT code, coalesce(name, code) AS name, 0 AS term_no, coalesce(name, code) AS term FROM {dim}
    UNION ALL SELECT code, name, 1, code FROM {dim} WHERE name IS NOT NULL AND name <> code"""

KEYWORD = {
    "terms": STATION_TERMS,
    "kw_hits": """
        SELECT code, term_no, term, collection, doc_id, tf, both_terms, score FROM (
            SELECT code, term_no, term, collection, doc_id, (length(low) - length(replace(low, lower(term), ''))) // length(term) AS tf,
                   contains(low, lower(name)) AND contains(low, lower(code)) AS both_terms,
                   round((0.7::double + 0.2::double * least(((length(low) - length(replace(low, lower(term), ''))) // length(term)) / 5.0::double, 1.0::double)
                          + CASE WHEN contains(low, lower(name)) AND contains(low, lower(code)) THEN 0.1::double ELSE 0 END)
                         * CASE WHEN collection = 'train_routes' THEN 1.0::double ELSE 0.85::double END, 4) AS score
            FROM (SELECT *, lower(content) AS low FROM {docs} WHERE collection IN ('train_routes', 'stations')) JOIN {terms} ON contains(content, term))
        WHERE score >= CASE WHEN collection = 'train_routes' THEN 0.65 ELSE 0.75 END""",
}

SEARCH = {
    **{k: v for k, v in mentions("expanded_q", "expanded").items()},
    **KEYWORD,
    "expanded_q": f"SELECT question_id, question, {synonyms('question')} AS expanded FROM {{search_questions}}",
    "codes_found": f"""
        SELECT t, name, code, min(pos) AS pos FROM (
            SELECT t, coalesce(d.name, d.code) AS name, d.code, length(regexp_extract(t, '(?s)^(.*?)\\b' || raw || '\\b', 1)) AS pos
            FROM (SELECT t, unnest(list_distinct(regexp_extract_all(t, '\\b([a-zA-Z]{{2,5}})\\b', 1))) AS raw FROM {{texts}}) JOIN {{dim}} d ON d.code = upper(raw)
            WHERE upper(raw) NOT IN {values(fv.CODE_NOISE)}) WHERE (t, code) NOT IN (SELECT (t, code) FROM {{named}}) GROUP BY ALL""".replace("{{", "{").replace("}}", "}"),
    "found": """
        SELECT question_id, name, code, row_number() OVER (PARTITION BY question_id ORDER BY pos, name, code) AS s_no
        FROM (SELECT * FROM {named} UNION ALL SELECT * FROM {codes_found}) f JOIN {expanded_q} ON expanded = t""",
    "prepared": f"""
        SELECT e.question_id, e.question, e.expanded, coalesce(names, []) AS names, coalesce(codes, []) AS codes, {_ROUTING} AS active,
               expanded || coalesce(' ' || nullif(extra, ''), '') AS search_text
        FROM {{expanded_q}} e LEFT JOIN (
            SELECT f.question_id, list(name ORDER BY s_no) AS names, list(code ORDER BY s_no) AS codes,
                   string_agg(CASE WHEN NOT contains(lower(expanded), lower(code)) AND NOT contains(lower(expanded), lower(name)) THEN code || ' ' || name
                                   WHEN NOT contains(lower(expanded), lower(code)) THEN code WHEN NOT contains(lower(expanded), lower(name)) THEN name END, ' ' ORDER BY s_no) AS extra
            FROM {{found}} f JOIN {{expanded_q}} x ON x.question_id = f.question_id GROUP BY f.question_id) s ON s.question_id = e.question_id""",
    "exact_list": """
        SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY collection = 'train_routes', pos, doc_id) - 1 AS rank, doc_id, 1.0::double AS score
        FROM (SELECT question_id, unnest(nums) AS num, unnest(generate_series(1, len(nums))) AS pos
              FROM (SELECT question_id, regexp_extract_all(question, '\\b(\\d{5})\\b', 1) AS nums FROM {search_questions})) JOIN {docs} ON train_no = num""",
    "kw_list": """
        SELECT f.question_id, row_number() OVER (PARTITION BY f.question_id ORDER BY s_no, collection = 'train_routes', term_no, doc_id) - 1 AS rank, doc_id, score
        FROM {found} f JOIN {prepared} p ON p.question_id = f.question_id JOIN {kw_hits} k ON k.code = f.code AND list_contains(active, collection)""",
    "emb_docs": embedding("docs", "content", "doc_id", "collection"),
    "emb_q": embedding("prepared", "search_text", "question_id"),
    "near": """
        SELECT question_id, collection, doc_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id, collection ORDER BY score DESC, doc_id) AS rank
            FROM (SELECT question_id, collection, doc_id, list_inner_product(q.v, d.v) AS raw, round(list_inner_product(q.v, d.v), 4) AS score FROM {emb_q} q, {emb_docs} d)
            WHERE raw >= 0.3) WHERE rank <= 5""",
    "semantic_list": """
        SELECT question_id, rank, doc_id, score FROM (
            SELECT n.question_id, doc_id, score, row_number() OVER (PARTITION BY n.question_id ORDER BY score DESC, collection, doc_id) - 1 AS rank
            FROM {near} n JOIN {prepared} p ON p.question_id = n.question_id AND list_contains(active, collection)) WHERE rank < 10""",
    "ranked": """
        SELECT question_id, 0 AS list_no, rank, doc_id, score FROM {exact_list} UNION ALL SELECT question_id, 1, rank, doc_id, score FROM {kw_list}
        UNION ALL SELECT question_id, 2, rank, doc_id, score FROM {semantic_list}""",
    "fused": """
        SELECT question_id, prefix, round(sum(1.0::double / (61 + rank)), 12) AS rrf, arg_max(doc_id, (score, -list_no, -rank)) AS doc_id, max(score) AS score,
               min((list_no, rank, doc_id)) AS first_seen
        FROM (SELECT r.*, substr(content, 1, 100) AS prefix FROM {ranked} r JOIN {docs} d ON d.doc_id = r.doc_id) GROUP BY question_id, prefix""",
    "checked": """
        SELECT c.*, CASE WHEN source_type = 'train_route' AND len(codes) >= 2 THEN true ELSE false END AS valid_route
        FROM (SELECT f.question_id, f.doc_id, f.score, f.rrf, f.first_seen, d.collection, d.source_type, d.content, d.train_no, d.station_code, p.names, p.codes, p.question,
                     lower(content) AS low, list_transform(string_split(lower(string_split(content, 'Stops')[2]), '>'), lambda x: trim(x)) AS ss
              FROM {fused} f JOIN {docs} d ON d.doc_id = f.doc_id JOIN {prepared} p ON p.question_id = f.question_id) c
        WHERE source_type <> 'train_route' OR len(codes) < 2
           OR ((contains(low, lower(names[1])) OR contains(low, lower(codes[1]))) AND (contains(low, lower(names[2])) OR contains(low, lower(codes[2])))
               AND NOT coalesce(list_position(list_transform(ss, lambda x: contains(x, lower(names[1])) OR contains(x, lower(codes[1]))), true)
                                >= list_position(list_transform(ss, lambda x: contains(x, lower(names[2])) OR contains(x, lower(codes[2]))), true), false))""",
    "kept": """
        SELECT c.* FROM {checked} c
        WHERE (c.collection <> 'trains' OR NOT exists (SELECT 1 FROM {checked} v WHERE v.question_id = c.question_id AND v.valid_route)
               OR exists (SELECT 1 FROM {checked} v WHERE v.question_id = c.question_id AND v.valid_route AND v.train_no = c.train_no))
          AND (len(c.codes) = 0 OR c.source_type <> 'station' OR list_contains(c.codes, upper(c.station_code)))""",
    "positioned": """
        SELECT * FROM (
            SELECT k.*, n.question_id IS NOT NULL AS number_found, row_number() OVER (PARTITION BY k.question_id ORDER BY valid_route DESC, rrf DESC, first_seen) AS position
            FROM {kept} k LEFT JOIN (SELECT DISTINCT question_id FROM {exact_list}) n ON n.question_id = k.question_id)
        WHERE position <= CASE WHEN len(codes) > 0 OR number_found THEN 25 ELSE 10 END""",
    "results": """
        SELECT question_id, position, doc_id, collection, source_type, score, round(rrf, 6) AS rrf_score, train_no, station_code, names, codes,
               CASE WHEN source_type = 'train_route' AND len(codes) > 0 AND NOT number_found AND len(stops) > 4
                    THEN substr(content, 1, strpos(content, 'Stops') - 1) || 'Stops (' || len(stops) || ' total, key stops shown): '
                         || array_to_string(list_filter(stops, lambda x, i: i = 1 OR i = len(stops)
                                OR len(list_filter(names, lambda t: contains(lower(x), lower(t)))) > 0 OR len(list_filter(codes, lambda t: contains(lower(x), lower(t)))) > 0), ' > ')
                    ELSE content END AS content
        FROM (SELECT *, list_filter(list_transform(string_split(trim(substr(section, strpos(section, ':') + 1)), '>'), lambda x: trim(x)), lambda x: x <> '') AS stops
              FROM (SELECT *, substr(content, strpos(content, 'Stops')) AS section FROM {positioned}))""",
}


CHECK_BETWEEN = {
    "first_at": "SELECT train_no, station_code, min(seq) AS seq FROM {stops} GROUP BY ALL",
    "asked": "SELECT DISTINCT src_code AS origin, dst_code AS target FROM {ends} UNION SELECT dst_code, src_code FROM {ends}",
    "both_ways": """
        SELECT cast(10000 + order_key as varchar) AS train_no, 'there' AS way, src_name AS n1, src_code AS c1, dst_name AS n2, dst_code AS c2 FROM {ends}
        UNION ALL SELECT cast(10000 + order_key as varchar), 'back', dst_name, dst_code, src_name, src_code FROM {ends}""",
    "asked_docs": """
        SELECT b.train_no || '-' || way AS question_id, b.*, d.doc_id, d.collection, d.content, lower(d.content) AS low,
               string_split(lower(string_split(d.content, 'Stops')[2]), '>') AS ss
        FROM {both_ways} b JOIN {docs} d ON d.train_no = b.train_no""",
    "validated": """
        SELECT *, collection = 'train_routes' AS valid_route FROM {asked_docs}
        WHERE collection = 'trains' OR ((contains(low, lower(n1)) OR contains(low, lower(c1))) AND (contains(low, lower(n2)) OR contains(low, lower(c2)))
              AND NOT coalesce(list_position(list_transform(ss, lambda x: contains(x, lower(n1)) OR contains(x, lower(c1))), true)
                               >= list_position(list_transform(ss, lambda x: contains(x, lower(n2)) OR contains(x, lower(c2))), true), false))""",
    "mixed": "SELECT c1 || '-' || right(train_no, 1) AS question_id, doc_id, collection, train_no, valid_route FROM {validated}",
}
