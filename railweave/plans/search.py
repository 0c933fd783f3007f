"""Queries over retrieval: keyword, vector and exact search, fusion, validation, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions.runtime import materialise, scratch_path
from railweave.operators import postings as po
from railweave.operators import quality as ql
from railweave.operators import retrieve as rt
from railweave.operators import search as se
from railweave.operators import vector_index as vi
from railweave.operators import vectors as vc
from railweave.plans import question_checks as qc
from railweave.plans.registry import query


def prepared(r):
    """Search questions with expanded text, stations and search text, stored as several steps read them."""
    stations = r.station_dim()
    expanded = rt.expand_synonyms(r.asked())
    return materialise(rt.rewrite_query(se.resolve_stations(expanded, r.aliases(), stations)), "prepared")


@query("ret02_rewrite_query", """
    SELECT question_id, array_to_string(codes, ',') AS codes, search_text FROM {prepared}""", recursive=True, **qc.SEARCH)
def _(r):
    codes = F.array_join(F.transform("stations", lambda s: s["code"]), ",").alias("codes")
    return prepared(r).select("question_id", codes, "search_text")


@query("jn09_keyword_join", "SELECT code, term_no, term, collection, doc_id FROM {kw_hits}", **qc.KEYWORD)
def _(r):
    return rt.keyword_join(r.search_docs(), r.station_dim()).select("code", "term_no", "term", "collection", "doc_id")


@query("jn09_contains_join", """
    SELECT item, d.doc_id, contains(text, item) AS same_case FROM (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS item FROM {benchmark}) t
    JOIN (SELECT doc_id, text FROM {documents}) d ON contains(lower(text), lower(item)) WHERE item <> ''""")
def _(r):
    """Every word of the benchmark texts in every document that contains it."""
    terms = r.benchmark.select(F.explode(F.split("text", r"\s+")).alias("term")).where("term <> ''")
    docs = r.documents.select("doc_id", F.col("text").alias("content"), F.col("lang").alias("collection"))
    return rt.contains_join(docs, terms).select(F.col("term").alias("item"), "doc_id", "same_case")


@query("ret04_keyword_score", "SELECT code, term_no, collection, doc_id, tf, both_terms, score FROM {kw_hits}", **qc.KEYWORD)
def _(r):
    return rt.keyword_join(r.search_docs(), r.station_dim()).select("code", "term_no", "collection", "doc_id", "tf", "both_terms", "score")


def _stored(r):
    """Posting lists of all stations, written and read back."""
    path = scratch_path(r.spark, "postings")
    po.write_postings(rt.keyword_join(r.search_docs(), r.station_dim()), path)
    return po.read_postings(r.spark, path)


@query("jn09_stored_postings", "SELECT code, term_no, term, collection, doc_id, tf, both_terms, score FROM {kw_hits}", **qc.KEYWORD)
def _(r):
    return po.postings(_stored(r)).drop("same_case")


@query("ret04_postings_topk", """
    SELECT question_id, doc_id, score, rank FROM (
        SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT order_key AS question_id, doc_id, max(score) AS score FROM {ends} JOIN {kw_hits} ON code IN (src_code, dst_code) GROUP BY order_key, doc_id))
    WHERE rank <= 10""", **qc.KEYWORD)
def _(r):
    """The ten best documents about each train's first and last station, from the stored lists."""
    pairs = r.ends.select("order_key", F.array_sort(F.array_distinct(F.array("src_code", "dst_code"))).alias("codes"))
    # questions about the same stations are one search
    asked = pairs.select("codes").distinct().withColumn("question_id", F.array_join("codes", ">"))
    best = po.postings_topk(_stored(r), asked.select("question_id", F.explode("codes").alias("code")), 10)
    named = pairs.select("order_key", F.array_join("codes", ">").alias("question_id"))
    return named.join(best, "question_id").select(F.col("order_key").alias("question_id"), "doc_id", "score", "rank")


_CENTROIDS = dict(
    corpus="SELECT vec_id AS doc_id, label AS collection, list_transform(embedding, lambda x: cast(x as double)) AS v FROM {embeddings}",
    centres="""
    SELECT label AS question_id, list(m / norm ORDER BY dim) AS v FROM (
        SELECT label, dim, m, sqrt(sum(m * m) OVER (PARTITION BY label)) AS norm FROM (
            SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(generate_series(1, 64)) AS dim, unnest(list_transform(embedding, lambda x: cast(x as double))) AS x FROM {embeddings})
            GROUP BY label, dim)) GROUP BY label""",
    hits="""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, collection ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT question_id, collection, doc_id, round(list_inner_product(q.v, d.v), 4) AS score FROM {centres} q, {corpus} d
        WHERE list_inner_product(q.v, d.v) >= 0.15)) WHERE rank <= 5""")


def _centroid_hits(r):
    """The centre of each label asks; every vector of every label may answer."""
    e = r.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    means = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
    centres = lists.select(F.col("label").alias("question_id"), F.transform("v", lambda x: x["m"] / F.col("norm")).alias("embedding"))
    corpus = r.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("collection"), "embedding")
    return vc.vector_topk(centres, corpus, min_score=0.15)


@query("ret05_vector_topk", "SELECT question_id, collection, doc_id, score, rank FROM {hits}", **_CENTROIDS)
def _(r):
    return _centroid_hits(r)


@query("ret05_vector_topk_documents", "SELECT question_id, collection, doc_id, score, rank FROM {near}", recursive=True, **qc.SEARCH)
def _(r):
    asked = vc.hashed_embedding(prepared(r).select("question_id", "search_text"), "search_text")
    return vc.vector_topk(asked, r.embedded_docs())


@query("ret05_vector_index")
def _(r):
    """The same questions through the index; tests hold its recall against the exact search."""
    path = scratch_path(r.spark, "vector-index")
    model = vi.fit_index(r.embedded_docs())
    vi.build_index(r.embedded_docs(), model, path)
    asked = vc.hashed_embedding(prepared(r).select("question_id", "search_text"), "search_text")
    return vi.indexed_topk(asked, vi.read_index(r.spark, path), model)


@query("ret06_merge_topk", """
    SELECT * FROM (SELECT question_id, collection, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, collection, doc_id) - 1 AS rank FROM {hits})
    WHERE rank < 10""", **_CENTROIDS)
def _(r):
    return vc.merge_topk(_centroid_hits(r))


@query("udf01_embed_documents", """
    SELECT doc_id, dim, round(v[dim + 1], 6) AS value FROM (SELECT doc_id, unnest(generate_series(0, 63)) AS dim, v FROM {vectors})""",
       vectors=qc.embedding("documents", "text", "doc_id"))
def _(r):
    vectors = vc.hashed_embedding(r.documents.select("doc_id", "text"), "text")
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("udf01_fitted_term_weights", """
    SELECT doc_id, dim, round(v, 6) AS value FROM (
        SELECT doc_id, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-12) AS v FROM (
            SELECT doc_id, dim, coalesce(n, 0) * ln((total + 1.0::double) / (coalesce(docs, 0) + 1.0::double)) AS x
            FROM (SELECT doc_id, unnest(generate_series(0, 63)) AS dim, count(*) OVER () AS total FROM {documents})
            LEFT JOIN {term_counts} USING (doc_id, dim) LEFT JOIN (SELECT dim, count(*) AS docs FROM {term_counts} GROUP BY dim) USING (dim)))""",
       term_counts="""
    SELECT doc_id, cast('0x' || substr(md5(w), 1, 8) as bigint) % 64 AS dim, count(*) AS n
    FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+')) AS w FROM {documents}) WHERE w <> '' GROUP BY ALL""")
def _(r):
    """Weights fitted over all documents, stored, read back and applied."""
    texts = r.documents.select("doc_id", "text")
    weights = materialise(vc.fit_term_weights(texts, "text"), "term-weights")
    vectors = vc.hashed_embedding(texts, "text", weights=weights)
    return vectors.select("doc_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("udf01_embed_model_hook")
def _(r):
    """The model hook with a small stand-in model: text length and word count."""
    def model():
        return lambda texts: [[float(len(t)), float(len(t.split()))] for t in texts]

    return vc.embed_documents(r.documents.select("doc_id", "text"), model, "text").select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


def _lists(r):
    """Exact and vector lists of the search questions over all documents."""
    docs = r.search_docs()
    p = prepared(r).withColumn("active", rt.route_collections("expanded"))
    exact = rt.exact_lookup(r.asked(), docs, per_number=fv.EXACT_PER_NUMBER)
    near = vc.vector_topk(vc.hashed_embedding(p.select("question_id", "search_text", "active"), "search_text"), r.embedded_docs(), wanted="active")
    active = near.join(p.select("question_id", "active"), "question_id").where(F.array_contains("active", F.col("collection")))
    semantic = vc.merge_topk(active).withColumn("source", F.lit("semantic"))
    return docs, exact, semantic


_TWO_LISTS = dict(qc.SEARCH, ranked="""
    SELECT question_id, 0 AS list_no, rank, doc_id, score FROM {exact_list} UNION ALL SELECT question_id, 1, rank, doc_id, score FROM {semantic_list}
    UNION ALL SELECT question_id, 2, rank, doc_id, score FROM {exact_list}""")


@query("set02_union_ranked", "SELECT question_id, list_no, rank, doc_id, score FROM {ranked}", recursive=True, **_TWO_LISTS)
def _(r):
    _, exact, semantic = _lists(r)
    return rt.union_ranked(exact, semantic, exact).select("question_id", "list_no", "rank", "doc_id", "score")


@query("ret07_rrf_fuse", """
    SELECT question_id, doc_id, score, round(rrf, 6) AS rrf_score, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, first_seen) - 1 AS rank FROM {fused}""",
       recursive=True, **_TWO_LISTS)
def _(r):
    """The exact list counts twice, so repeats across lists add up."""
    docs, exact, semantic = _lists(r)
    return rt.rrf_fuse(rt.union_ranked(exact, semantic, exact), docs, prefix_len=fv.DEDUPE_PREFIX)


@query("ret08_dedupe_prefix", """
    SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, substr(text, 1, 100) ORDER BY doc_id) AS n FROM {documents}) WHERE n = 1""")
def _(r):
    return rt.dedupe_prefix(r.documents.select("lang", "doc_id", "text"), "lang", "doc_id", "text", prefix_len=fv.DEDUPE_PREFIX).select("lang", "doc_id")


@query("ret08_dedupe_text", "SELECT lang, min(doc_id) AS doc_id FROM {documents} GROUP BY lang, text")
def _(r):
    """Whole texts: equal beginnings alone do not make two documents one."""
    return rt.dedupe_prefix(r.documents.select("lang", "doc_id", "text"), "lang", "doc_id", "text").select("lang", "doc_id")


_ROUTES = qc.CHECK_BETWEEN


@query("jn15_between_stations", """
    SELECT p.origin, p.target, a.train_no, a.seq AS from_seq, b.seq AS to_seq FROM {asked} p JOIN {first_at} a ON a.station_code = p.origin
    JOIN {first_at} b ON b.train_no = a.train_no AND b.station_code = p.target WHERE a.seq < b.seq""", **_ROUTES)
def _(r):
    e = r.ends
    pairs = e.select(F.col("src_code").alias("origin"), F.col("dst_code").alias("target")).unionByName(
        e.select(F.col("dst_code").alias("origin"), F.col("src_code").alias("target")))
    return rt.between_stations(r.stops, pairs)


def _route_candidates(r):
    """Each train's route and train document as candidates for two questions: its own ends, and its ends swapped."""
    docs = r.search_docs().where(F.col("collection").isin("trains", "train_routes"))
    keys = (F.col("order_key") + 10000).cast("string")
    end = lambda n: F.struct(F.col(f"{n}_name").alias("name"), F.col(f"{n}_code").alias("code"))
    ways = F.explode(F.array(F.struct(F.lit("there").alias("way"), F.array(end("src"), end("dst")).alias("stations")),
                             F.struct(F.lit("back").alias("way"), F.array(end("dst"), end("src")).alias("stations"))))
    # both questions meet the same documents, so a train meets them once
    found = r.ends.select(keys.alias("train_no"), "src_name", "src_code", "dst_name", "dst_code").join(docs, "train_no")
    return (found.withColumn("a", ways).select(F.concat("train_no", F.lit("-"), "a.way").alias("question_id"), "train_no", "a.stations",
                                               *[c for c in docs.columns if c != "train_no"], F.col("doc_id").alias("rank")))


@query("ret09_validate_route", "SELECT question_id, doc_id, valid_route FROM {validated}", **_ROUTES)
def _(r):
    return rt.validate_route(_route_candidates(r)).select("question_id", "doc_id", "valid_route")


@query("jn13_drop_wrong_trains", """
    SELECT v.question_id, v.doc_id FROM {mixed} v LEFT JOIN (SELECT DISTINCT question_id FROM {mixed} WHERE valid_route) a ON a.question_id = v.question_id
    LEFT JOIN (SELECT DISTINCT question_id, train_no FROM {mixed} WHERE valid_route) o ON o.question_id = v.question_id AND o.train_no = v.train_no
    WHERE v.collection <> 'trains' OR a.question_id IS NULL OR o.train_no IS NOT NULL""", **_ROUTES)
def _(r):
    """Questions of a station pair see the documents of all trains with these ends."""
    valid = rt.validate_route(_route_candidates(r))
    mixed = valid.withColumn("question_id", F.concat(F.col("stations")[0]["code"], F.lit("-"), F.substring("train_no", -1, 1)))
    return rt.drop_wrong_trains(mixed).select("question_id", "doc_id")


@query("jn12_enrich_route_names", """
    SELECT question_id, doc_id, content || CASE WHEN valid_route AND runs_on <> '' THEN ' | Runs on: ' || runs_on ELSE '' END AS content
    FROM {validated} v LEFT JOIN {name_map} m ON m.train_no = v.train_no
    UNION ALL SELECT v.question_id, d.doc_id, d.content FROM {validated} v JOIN {docs} d ON d.train_no = v.train_no AND d.collection = 'trains' WHERE v.valid_route""", **_ROUTES)
def _(r):
    valid = rt.validate_route(_route_candidates(r)).withColumn("score", F.lit(1.0))
    return rt.enrich_route_names(valid, r.search_docs()).select("question_id", "doc_id", "content")


@query("jn14_drop_wrong_stations", """
    SELECT question_id, doc_id FROM {near} JOIN {docs} d USING (doc_id) JOIN {prepared} USING (question_id)
    WHERE len(codes) = 0 OR source_type <> 'station' OR list_contains(codes, upper(d.station_code))""", recursive=True, **qc.SEARCH)
def _(r):
    docs = r.search_docs()
    p = prepared(r)
    near = vc.vector_topk(vc.hashed_embedding(p.select("question_id", "search_text"), "search_text"), r.embedded_docs())
    candidates = near.drop("collection").join(docs, "doc_id").join(p.select("question_id", "stations"), "question_id")
    return rt.drop_wrong_stations(candidates).select("question_id", "doc_id")


@query("ret10_trim_route", """
    SELECT question_id, CASE WHEN len(stops) > 4 THEN substr(content, 1, strpos(content, 'Stops') - 1) || 'Stops (' || len(stops) || ' total, key stops shown): '
           || array_to_string(list_filter(stops, lambda x, i: i = 1 OR i = len(stops) OR contains(lower(x), lower(n1)) OR contains(lower(x), lower(c1))
                              OR contains(lower(x), lower(n2)) OR contains(lower(x), lower(c2))), ' > ') ELSE content END AS content
    FROM (SELECT *, list_filter(list_transform(string_split(trim(substr(section, strpos(section, ':') + 1)), '>'), lambda x: trim(x)), lambda x: x <> '') AS stops
          FROM (SELECT *, substr(content, strpos(content, 'Stops')) AS section FROM {validated} WHERE collection = 'train_routes'))""", **_ROUTES)
def _(r):
    valid = rt.validate_route(_route_candidates(r)).where(F.col("collection") == "train_routes").withColumn("number_found", F.lit(False))
    return rt.trim_routes(valid).select("question_id", "content")


@query("ret11_limit_results", """
    SELECT lang, doc_id, position FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang || source ORDER BY n_chars DESC, doc_id) AS position FROM {documents})
    WHERE position <= CASE WHEN lang = 'en' THEN 25 ELSE 10 END""")
def _(r):
    docs = r.documents.withColumn("question_id", F.concat("lang", "source")).withColumn("has_entity", F.col("lang") == "en")
    return rt.limit_results(docs, order=(F.desc("n_chars"), "doc_id")).select("lang", "doc_id", "position")


def searched(r):
    """Hybrid search of all search questions over all documents, with the published limits."""
    return se.hybrid_search(r.asked(), r.embedded_docs(), r.station_dim(), r.aliases(), per_number=fv.EXACT_PER_NUMBER, prefix_len=fv.DEDUPE_PREFIX)


@query("ret16_hybrid_search", """
    SELECT question_id, position, doc_id, collection, score, rrf_score, content FROM {results}""", recursive=True, **qc.SEARCH)
def _(r):
    return searched(r).select("question_id", "position", "doc_id", "collection", "score", "rrf_score", "content")


@query("ret16_hybrid_search_questions")
def _(r):
    """All questions, nothing merged or cut but the number of results; tests hold it against brute force."""
    found = se.hybrid_search(r.questions.select("question_id", "question"), r.embedded_docs(), r.station_dim(), r.aliases())
    return found.select("question_id", "position", "doc_id", "collection", "score", "rrf_score", "content")


_CONTEXT = dict(qc.SEARCH, budgeted="""
    SELECT question_id, count(*) AS documents, string_agg('[Doc ' || i || ' | ' || collection || ' | relevance: ' || score || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context
    FROM (SELECT *, sum(length(content)) OVER (PARTITION BY question_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY question_id ORDER BY position) AS i FROM {results})
    WHERE total <= 12000 OR i = 1 GROUP BY question_id""")


@query("ret12_context_budget", "SELECT question_id, documents, context FROM {budgeted}", recursive=True, **_CONTEXT)
def _(r):
    return rt.context_budget(searched(r))


@query("ret12_context_or_none", """
    SELECT question_id, coalesce(documents, 0) AS documents, coalesce(context, 'No relevant documents found.') AS context FROM {search_questions} LEFT JOIN {budgeted} USING (question_id)""",
       recursive=True, **_CONTEXT)
def _(r):
    return rt.context_or_none(r.asked(), searched(r))


@query("ret12_context_budget_texts", """
    SELECT grp AS question_id, count(*) AS documents, cast(sum(length(text)) as bigint) AS chars
    FROM (SELECT *, sum(length(text)) OVER (PARTITION BY grp ORDER BY n ROWS UNBOUNDED PRECEDING) AS total FROM (
            SELECT lang || source AS grp, text, row_number() OVER (PARTITION BY lang || source ORDER BY doc_id) AS n FROM {documents})) WHERE total <= 12000 OR n = 1 GROUP BY grp""")
def _(r):
    """Long texts: the budget cuts, and a first text beyond the budget stays."""
    docs = r.documents.select(F.concat("lang", "source").alias("question_id"), "doc_id", F.col("text").alias("content"), F.lit(True).alias("has_entity"),
                              F.lit("railway_rules").alias("collection"), F.lit(1.0).alias("score"))
    kept = rt.context_budget(docs, order="doc_id")
    blocks = F.transform(F.split("context", "\n\n---\n\n\\[Doc "), lambda b: F.length(F.regexp_replace(b, r"^(\[Doc )?\d+ \| railway_rules \| relevance: 1\.0\]\n", "")))
    return kept.select("question_id", "documents", F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chars"))


@query("ret13_project_sources", """
    SELECT doc_id, source_type AS type, CASE WHEN source_type IN ('train', 'train_route') THEN coalesce(train_no, '') END AS train_no,
           CASE WHEN source_type = 'station' THEN coalesce(station_code, '') END AS station_code, 0.0::double AS relevance_score FROM {docs}""")
def _(r):
    docs = r.search_docs()
    for missing in ("score", "category", "rule_title", "ref_type"):
        if missing not in docs.columns:
            docs = docs.withColumn(missing, F.lit(None).cast("double" if missing == "score" else "string"))
    return rt.project_sources(docs).select("doc_id", "src.type", "src.train_no", "src.station_code", "src.relevance_score")


@query("ret14_no_route_answer", f"""
    SELECT question_id, CASE WHEN len(codes) >= 2 AND question_id NOT IN (SELECT question_id FROM {{results}} WHERE source_type = 'train_route') THEN
           'No direct trains were found from **' || names[1] || ' (' || codes[1] || ')** to **' || names[2] || ' (' || codes[2] || ')**' || {qc.q(fv.NO_ROUTE_TAIL)} END AS answer
    FROM {{prepared}}""".replace("{{", "{").replace("}}", "}"), recursive=True, **qc.SEARCH)
def _(r):
    return rt.no_route_answer(prepared(r), searched(r)).select("question_id", "answer")


@query("ret15_merge_context", """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'H' || chr(10) || chr(10) ELSE '' END || CASE WHEN role <> 'system' THEN 'L ' || turn || chr(10) || chr(10) ELSE '' END
           || '=== DATABASE RULES/TIMETABLES (STATIC) ===' || chr(10) || text AS context FROM {conversations}""")
def _(r):
    history = F.when(F.col("role") == "user", "H").otherwise("")
    live = F.when(F.col("role") != "system", F.concat(F.lit("L "), F.col("turn").cast("string"))).otherwise("")
    return r.conversations.select("conv_id", "turn", rt.merge_context(history, live, F.col("text")).alias("context"))


@query("agg07_sources_by_type", """
    SELECT question_id, source_type AS type, count(*) AS sources, string_agg(doc_id, ',' ORDER BY doc_id) AS items FROM {near} JOIN {docs} USING (doc_id) GROUP BY ALL""",
       recursive=True, **qc.SEARCH)
def _(r):
    docs = r.search_docs()
    near = vc.vector_topk(vc.hashed_embedding(prepared(r).select("question_id", "search_text"), "search_text"), r.embedded_docs())
    return (rt.sources_by_type(near.join(docs.select("doc_id", "source_type"), "doc_id"))
            .withColumn("items", F.array_join(F.col("items").cast("array<string>"), ",")))


@query("agg08_avg_relevance", """
    SELECT question_id, coalesce(round(avg(score), 4), 0.0) AS avg_relevance FROM (SELECT DISTINCT label AS question_id FROM {embeddings}) LEFT JOIN {hits} USING (question_id) GROUP BY question_id""", **_CENTROIDS)
def _(r):
    return rt.avg_relevance(r.embeddings.select(F.col("label").alias("question_id")).distinct(), _centroid_hits(r))


@query("eval02_retrieval_recall", """
    SELECT coalesce(round(avg(CASE WHEN hits >= n * 0.5 THEN 1.0 ELSE 0.0 END), 4), 0) AS retrieval_recall_50pct, round(sum(hits) / sum(n), 4) AS keyword_hit_rate,
           count(*) AS queries_tested, cast(sum(CASE WHEN hits >= n * 0.5 THEN 1 ELSE 0 END) as bigint) AS queries_passed
    FROM (SELECT question_id, len(kws) AS n, len(list_filter(kws, lambda k: contains(lower(coalesce(context, '')), lower(k)))) AS hits
          FROM (SELECT question_id, string_split(question, ' ') AS kws FROM {search_questions}) LEFT JOIN {budgeted} USING (question_id))""", recursive=True, **_CONTEXT)
def _(r):
    """The words of each search question are the keywords its context should hold."""
    contexts = rt.context_budget(searched(r)).select("question_id", "context")
    cases = r.asked().withColumn("expected_keywords", F.split("question", " ")).join(contexts, "question_id", "left")
    return ql.retrieval_recall(ql.keyword_hits(cases, intent=None))
