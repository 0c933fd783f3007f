"""The stages in a row against the same steps in plain Python, and on odd tables."""

import zlib

import numpy as np
import test_decontaminate
import test_near_dedup
from pyspark.sql import functions as F
from test_mixing import brute_targets
from test_token_files import PATH, Tokenizer

import corpus_pipeline
from railweave.llm import language_id, mixing
from railweave.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_steps(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    model = language_id.fit(docs)
    langs, scores = model.scores([r[1] for r in rows])
    rows = [r for r, lang, s in zip(rows, langs, scores, strict=True) if lang != language_id.UNKNOWN and s >= model.threshold]
    keep = {r[0] for r in test_near_dedup.brute([r[:2] for r in rows]) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    dirty = {r[0] for r in test_decontaminate.brute([r[:2] for r in rows], [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]) if r[5]}
    rows = [r for r in rows if r[0] not in dirty]

    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    text = {r[0]: r[1] for r in rows}
    start, copies = 0, {}
    for r in got:
        ids = [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    sizes = {}
    for d, t, _, s in rows:
        sizes.setdefault(s, {})[d] = len(test_near_dedup.WORD.findall(t or ""))
    target = brute_targets({s: sum(x.values()) for s, x in sizes.items()})
    for s, of in sizes.items():
        assert abs(sum(copies.get(d, 0) * n for d, n in of.items()) - target[s]) <= max(of.values()) / 2 + 1e-6


def test_stages_take_odd_and_empty_tables(spark, make, odd_rows):
    for rows in (odd_rows, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "tokens":
                assert out.count() == docs.count()
            else:
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), out.schema)


def test_mix_stage_is_the_operator(spark):
    docs = table(spark, SF, "documents")
    taken = corpus_pipeline.mix(spark, docs, SF).groupBy("doc_id").count().collect()
    wanted = mixing.copies(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    assert {r.doc_id: r["count"] for r in taken} == {r.doc_id: r.n for r in wanted}
