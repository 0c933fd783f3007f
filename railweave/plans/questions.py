"""Queries over questions: entities, classification, station mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.functions.runtime import materialise
from railweave.operators import classify as cl
from railweave.operators import retrieve as rt
from railweave.operators import sessions as ss
from railweave.operators import stations as st
from railweave.plans import question_checks as qc
from railweave.plans.registry import query


@query("txt01_extract_train_no", """
    SELECT question_id, coalesce(nullif(regexp_extract(question, '\\b(\\d{5})\\b', 1), ''), nullif(regexp_extract(question, '(?i)(?:train|no\\.?|number|#)\\s*(\\d{4})\\b', 1), '')) AS train_no
    FROM {questions}""")
def _(r):
    return r.questions.select("question_id", tx.train_number("question").alias("train_no"))


@query("txt02_extract_pnr", "SELECT question_id, nullif(regexp_extract(question, '\\b(\\d{10})\\b', 1), '') AS pnr FROM {questions}")
def _(r):
    return r.questions.select("question_id", tx.booking_number("question").alias("pnr"))


@query("txt03_extract_station_code", f"""
    SELECT question_id, list_filter(regexp_extract_all(question, '\\b([A-Z]{{2,4}})\\b', 1), lambda t: NOT list_contains({qc.listed(fv.STATION_CODE_EXCLUDE)}, t))[1] AS station_code
    FROM {{questions}}""".replace("{{", "{").replace("}}", "}"))
def _(r):
    return r.questions.select("question_id", tx.station_code_token("question").alias("station_code"))


@query("txt04_has_station", "SELECT question_id, question IN (SELECT question FROM {station_words}) AS station_word FROM {questions}", **qc.CLASSIFY)
def _(r):
    return cl.has_station(r.questions, st.station_vocabulary(r.station_dim())).select("question_id", "station_word")


@query("txt05_match_patterns", f"""
    SELECT question_id, {qc.pattern_case('question', 0)} AS pattern_category, cast({qc.pattern_case('question', 1)} as double) AS pattern_confidence FROM {{questions}}""")
def _(r):
    return cl.match_patterns(r.questions).select("question_id", "pattern_category", "pattern_confidence")


@query("txt06_count_keywords", """
    SELECT question_id, array_to_string(live, ',') AS live_hits, array_to_string(sched, ',') AS schedule_hits, array_to_string(stat, ',') AS static_hits,
           array_to_string(rout, ',') AS routing_hits, gen AS general_hit FROM {questions} q JOIN {kw} k ON k.question = q.question""", **qc.CLASSIFY)
def _(r):
    names = ["live_hits", "schedule_hits", "static_hits", "routing_hits"]
    return cl.count_keywords(r.questions).select("question_id", *[F.array_join(n, ",").alias(n) for n in names], "general_hit")


@query("txt07_score_intent", """
    SELECT question_id, fc AS category, round(fconf, 2) AS confidence FROM {questions} q JOIN {decided} d ON d.question = q.question""", **qc.CLASSIFY)
def _(r):
    """The decision by keywords alone, for all questions."""
    prepared = cl.count_keywords(cl.extract_entities(cl.has_station(r.questions, st.station_vocabulary(r.station_dim()))))
    return cl.score_intent(prepared).select("question_id", "category", "confidence")


@query("txt08_coarse_intent", f"SELECT question_id, pc AS category, {qc.COARSE.replace('{c}', 'pc')} AS intent FROM (SELECT question_id, {qc.pattern_case('question', 0)} AS pc FROM {{questions}})")
def _(r):
    return cl.match_patterns(r.questions).select("question_id", F.col("pattern_category").alias("category"), cl.coarse_intent(F.col("pattern_category")).alias("intent"))


def classified(r):
    return cl.classify_questions(r.kept_questions(), st.station_vocabulary(r.station_dim()))


@query("txt09_classify_questions", "SELECT question_id, c.* FROM {questions} q JOIN {classified} c ON c.question = q.question", **qc.CLASSIFY)
def _(r):
    return classified(r).withColumn("reasons", F.array_join("reasons", " ; ")).drop("session_id", "ts")


_UPGRADED = dict(**qc.CLASSIFY, upgraded=f"""
    SELECT question_id, question, CASE WHEN train_no IS NULL AND session_train IS NOT NULL AND intent = 'STATIC' AND intent_category NOT IN {qc.values(fv.UPGRADE_EXEMPT)}
                                  AND {qc.any_contains('lower(question)', fv.UPGRADE_WORDS)} THEN 'HYBRID' ELSE intent END AS intent,
           coalesce(train_no, session_train) AS train_no, is_pnr, pnr
    FROM (SELECT question_id, q.question, intent, intent_category, train_no, is_pnr, pnr,
                 last_value(train_no IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, question_id ROWS UNBOUNDED PRECEDING) AS session_train
          FROM {{questions}} q JOIN {{classified}} c ON c.question = q.question)""".replace("{{", "{").replace("}}", "}"))


def upgraded(r):
    """The classified questions are stored: carrying a train number on reads them twice."""
    return cl.session_upgrade(ss.carry_train(materialise(classified(r), "classified")))


@query("txt10_session_upgrade", "SELECT question_id, intent, train_no FROM {upgraded}", **_UPGRADED)
def _(r):
    return upgraded(r).select("question_id", "intent", "train_no")


@query("txt11_data_needs", """
    SELECT question_id, is_pnr AND pnr IS NOT NULL AS needs_booking, NOT (is_pnr AND pnr IS NOT NULL) AND intent IN ('STATIC', 'HYBRID') AS needs_static,
           NOT (is_pnr AND pnr IS NOT NULL) AND intent IN ('LIVE', 'HYBRID') AND train_no IS NOT NULL AS needs_live,
           CASE WHEN train_no IS NOT NULL AND NOT contains(question, train_no) THEN question || ' train ' || train_no ELSE question END AS search_text FROM {upgraded}""", **_UPGRADED)
def _(r):
    return cl.data_needs(upgraded(r)).select("question_id", "needs_booking", "needs_static", "needs_live", "search_text")


@query("txt12_question_key", "SELECT doc_id, md5(lower(trim(text))) AS question_key FROM {documents}")
def _(r):
    return r.documents.select("doc_id", tx.question_key("text").alias("question_key"))


@query("txt13_parse_labelled_fields", """
    SELECT page_id, trim(regexp_extract(t, '(?im)^DESCRIPTION:\\s*(.+)$', 1)) AS description, starts_with(upper(trim(regexp_extract(t, '(?im)^IS_RAILWAY:\\s*(.+)$', 1))), 'YES') AS is_railway,
           trim(regexp_extract(t, '(?im)^QUERY:\\s*(.+)$', 1)) AS asked
    FROM (SELECT page_id, 'description: ' || url || chr(10) || 'IS_RAILWAY: ' || CASE WHEN contains(url, 'https') THEN 'yes' ELSE 'No' END || chr(10)
                 || CASE WHEN contains(url, '/en/') THEN 'Query:   page ' || page_id ELSE '' END AS t FROM {pages})""")
def _(r):
    text = F.concat(F.lit("description: "), "url", F.lit("\nIS_RAILWAY: "), F.when(F.col("url").contains("https"), "yes").otherwise("No"), F.lit("\n"),
                    F.when(F.col("url").contains("/en/"), F.concat(F.lit("Query:   page "), F.col("page_id").cast("string"))).otherwise(""))
    return r.pages.withColumn("t", text).select("page_id", tx.labelled_field("t", "DESCRIPTION").alias("description"),
                                                F.upper(tx.labelled_field("t", "IS_RAILWAY")).startswith("YES").alias("is_railway"),
                                                tx.labelled_field("t", "QUERY").alias("asked"))


@query("txt14_truncate_preview", "SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview FROM {conversations}")
def _(r):
    return r.conversations.select("conv_id", "turn", tx.preview("text").alias("preview"))


# --------------------------------------------------------------- station mentions


@query("jn07_exact_lookup", """
    SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY collection = 'train_routes', pos, doc_id) - 1 AS rank, doc_id, 1.0::double AS score, train_no, collection
    FROM (SELECT question_id, unnest(nums) AS num, unnest(generate_series(1, len(nums))) AS pos
          FROM (SELECT question_id, regexp_extract_all(question, '\\b(\\d{5})\\b', 1) AS nums FROM {questions})) JOIN {docs} ON train_no = num""")
def _(r):
    docs = r.search_docs()  # first, so that the questions read the stored ends of trains
    return rt.exact_lookup(r.questions, docs, per_number=fv.EXACT_PER_NUMBER).drop("source")


@query("jn08_code_lookup", f"""
    SELECT DISTINCT question_id, coalesce(d.name, d.code) AS name, d.code
    FROM (SELECT question_id, unnest(regexp_extract_all(question, '\\b([a-zA-Z]{{2,5}})\\b', 1)) AS raw FROM {{questions}}) JOIN {{dim}} d ON d.code = upper(raw)
    WHERE upper(raw) NOT IN {qc.values(fv.CODE_NOISE)}""".replace("{{", "{").replace("}}", "}"))
def _(r):
    return st.code_lookup(r.questions, r.station_dim()).select("question_id", "name", "code")


@query("jn10_resolve_mentions", """
    SELECT question_id, m.mentions FROM {questions} JOIN (SELECT t, string_agg(code || '@' || pos, ',' ORDER BY pos, name, code) AS mentions FROM {named} GROUP BY t) m ON m.t = question""",
       recursive=True, **qc.mentions("questions", "question"))
def _(r):
    """Mentions depend on the text only, so each distinct text is resolved once."""
    texts = r.questions.select("question").distinct()
    found = st.resolve_mentions(texts, r.aliases(), key="question")
    joined = F.array_join(F.transform("mentions", lambda m: F.concat(m["code"], F.lit("@"), m["start"].cast("string"))), ",")
    return r.questions.join(found, "question").select("question_id", joined.alias("mentions"))


@query("jn10_resolve_station", """
    SELECT question_id, c.code, c.name FROM {questions} JOIN (SELECT t, arg_min(code, k) AS code, arg_min(name, k) AS name FROM {cand} GROUP BY t) c ON c.t = question""",
       **qc.mentions("questions", "question"))
def _(r):
    texts = r.questions.select("question").distinct()
    return r.questions.join(st.resolve_station(texts, r.aliases(), key="question"), "question").select("question_id", "code", "name")


@query("jn11_resolve_single")
def _(r):
    """The station of each question, also where its name is misspelt."""
    texts = r.questions.select("question").distinct()
    return r.questions.join(st.resolve_station_or_similar(texts, r.aliases(), key="question"), "question").select("question_id", "code", "name")


@query("jn11_fuzzy_resolve")
def _(r):
    """No SQL twin for the ratio; the tests compare it with a brute-force search."""
    texts = r.questions.select("question").distinct()
    found = st.fuzzy_resolve(texts, r.aliases(), key="question")
    return r.questions.join(found, "question").select("question_id", "word", "alias", F.round("ratio", 6).alias("ratio"), "name", "code")


@query("udf02_sequence_ratio")
def _(r):
    """Part names that are similar to each other, all pairs of distinct names."""
    names = r.part.select(F.col("p_name").alias("alias")).distinct()
    return st.similar_pairs(names.withColumnRenamed("alias", "word"), names, 0.8).withColumn("ratio", F.round("ratio", 6))


@query("ret01_expand_synonyms", f"SELECT question_id, {qc.synonyms('question')} AS expanded FROM {{questions}}")
def _(r):
    return rt.expand_synonyms(r.questions).select("question_id", "expanded")


@query("ret03_route_collections", f"""
    SELECT question_id, array_to_string({qc._ROUTING}, ',') AS collections FROM (SELECT question_id, question AS expanded FROM {{questions}})""")
def _(r):
    return r.questions.select("question_id", F.array_join(rt.route_collections("question"), ",").alias("collections"))
