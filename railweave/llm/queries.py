"""Registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.llm import decontaminate, hard_negatives, language_id, line_dedup, lm_scoring, merkle, mixing, near_dedup, pseudonyms, quality_gbt, token_files, unit_dedup, warc
from railweave.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


SHINGLE_WORDS = r"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words)"""


@query("op8_setsketch_near_dedup", rf"""
WITH RECURSIVE {SHINGLE_WORDS},
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_benchmark_decontamination", r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
lens AS (SELECT DISTINCT n FROM wins),
cuts AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, lens)),
found AS (SELECT doc_id, c.n, p, item_id FROM cuts c JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM found)) GROUP BY 1),
seen AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN seen USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op7_simple8b_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"))


@query("op10_range_line_dedup", r"""
WITH lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owned AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS owner FROM keyed),
judged AS (SELECT *, length(k) >= 10 AND doc_id <> owner AS gone FROM owned)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


@query("op6_quality_gbt")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gbt.judge(docs, quality_gbt.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_pivotal_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op1_unit_hash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeats(table(spark, sf_dir, "documents"))


@query("op2_cross_entropy_difference")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lm_scoring.score(docs, lm_scoring.fit(docs, labels.filter("quality = 1")))


#: Stands for a secret that a real job gets from its key store.
EXAMPLE_KEY = b"example key, not a secret"


@query("op4_feistel_pseudonyms")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), EXAMPLE_KEY)


@query("op12_merkle_manifest", r"""
WITH RECURSIVE f AS (SELECT *, coalesce(strlen(source)::VARCHAR || ':' || source, '-') AS fs, coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS fl, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS ft,
              coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') AS fd, coalesce(':' || lang, '-') AS g,
              list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda crc, b:
                  list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda r, k: xor(r >> 1, 3988292384::UBIGINT * (r & 1)), xor(crc, b)), 4294967295::UBIGINT) AS crc FROM documents),
made AS (SELECT doc_id, g, sha256(fd || fs || fl || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || ft) AS leaf,
                sha256(fd || fs || fl || coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1)::VARCHAR, '-') || ft) AS altered, xor(crc, 4294967295::UBIGINT) % 7 = 0 AS tampered FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM made),
nodes AS (SELECT 0 AS level, g, idx, n, leaf AS h FROM leaves
          UNION ALL SELECT level + 1, g, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, g, idx // 2),
subs AS (SELECT g, h, level AS depth, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, idx, n, h FROM subs
         UNION ALL SELECT level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2),
walk AS (SELECT l.g, l.idx AS leaf_idx, l.idx AS pos, 0 AS level, l.n, '' AS proof, CASE WHEN tampered THEN altered ELSE leaf END AS h FROM leaves l
         UNION ALL SELECT w.g, leaf_idx, pos // 2, w.level + 1, (w.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END)
         FROM walk w LEFT JOIN nodes s ON s.g = w.g AND s.level = w.level AND s.idx = xor(w.pos, 1::BIGINT) WHERE w.n > 1),
climb AS (SELECT w.g, leaf_idx, s.idx AS pos, 0 AS level, s.n, proof, w.h, s.h AS subroot FROM walk w JOIN subs s USING (g) WHERE w.n = 1
          UNION ALL SELECT c.g, leaf_idx, pos // 2, c.level + 1, (c.n + 1) // 2, proof || coalesce(t.h, ''), sha256(CASE WHEN pos % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END), subroot
          FROM climb c LEFT JOIN tops t ON t.level = c.level AND t.idx = xor(c.pos, 1::BIGINT) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN climb c ON c.g = l.g AND c.leaf_idx = l.idx AND c.n = 1""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), claimed=merkle.check_column()).drop("path")


@query("op13_warc_salvage", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM o""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


@query("op11_segment_hard_negatives", r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel=flipped)
