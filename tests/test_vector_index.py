"""Searches in the vector index against the exact search."""

import numpy as np
from pyspark.sql import functions as F

from railweave.functions.runtime import scratch_path
from railweave.operators import vector_index as vi
from railweave.operators import vectors as vc
from railweave.plans.roles import Roles

DOCS = "doc_id long, collection string, embedding array<double>"


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def clustered(seed, n, centres=40, dim=32):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return unit(middle[rng.integers(centres, size=n)] + 0.5 * rng.normal(size=(n, dim)))


def tables(spark, n_docs=6000, n_questions=150):
    d, q = clustered(1, n_docs + n_questions)[:n_docs], clustered(1, n_docs + n_questions)[n_docs:]
    docs = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(d)], DOCS)
    return docs, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, embedding array<double>")


def built(spark, docs, **options):
    path = scratch_path(spark, "index")
    part = options.pop("part", 256)
    model = vi.fit_index(docs, **options)
    vi.build_index(docs, model, path, part=part)
    return model, vi.read_index(spark, path)


def rows(df):
    return sorted((r.question_id, r.collection, r["rank"], r.doc_id, r.score) for r in df.collect())


def recall(spark, questions, docs, found, k=5):
    exact = {(r.question_id, r.collection, r.doc_id) for r in vc.vector_topk(questions, docs, k=k).collect()}
    return len(exact & {(r.question_id, r.collection, r.doc_id) for r in found.collect()}) / len(exact)


def test_every_document_is_in_one_bounded_part(spark):
    docs, _ = tables(spark)
    _, index = built(spark, docs.withColumn("embedding", F.when(F.col("doc_id") % 3 == 0, F.expr("array_repeat(0.125d, 32)")).otherwise(F.col("embedding"))), cells=32)
    ids = [r.doc for r in index.select(F.explode("ids").alias("doc")).collect()]
    assert sorted(ids) == list(range(6000))
    # a third of all rows is one vector: its cell has many parts
    assert index.agg(F.max(F.size("ids"))).first()[0] < 2 * 256 and index.groupBy("cell").count().agg(F.max("count")).first()[0] >= 4


def test_recall_of_clustered_vectors(spark):
    docs, questions = tables(spark)
    model, index = built(spark, docs, cells=64)
    found = vi.indexed_topk(questions, index, model, probes=24, survivors=60)
    assert recall(spark, questions, docs, found) >= 0.95
    # scores are exact, so what is found has the score that the exact search gives
    exact = {(r.question_id, r.doc_id): r.score for r in vc.vector_topk(questions, docs, k=100).collect()}
    assert all(abs(exact[r.question_id, r.doc_id] - r.score) < 1e-9 for r in found.collect() if (r.question_id, r.doc_id) in exact)


def test_all_cells_and_survivors_are_the_exact_search(spark):
    docs, questions = tables(spark, 900, 30)
    model, index = built(spark, docs, cells=16, part=64)
    found = vi.indexed_topk(questions, index, model, probes=16, survivors=900, block=7)
    assert rows(found) == rows(vc.vector_topk(questions, docs))


def test_recall_of_the_search_documents(spark):
    r = Roles(spark, "/root/testdata/sf0.01")
    questions = vc.hashed_embedding(r.asked(), "question")
    model, index = built(spark, r.embedded_docs(), part=1024)
    assert recall(spark, questions, r.embedded_docs(), vi.indexed_topk(questions, index, model)) >= 0.95


def test_lists_are_sent_once_for_many_questions(spark):
    """The codes that meet questions do not multiply with the questions' number, and no pair of all blocks is made."""
    docs, questions = tables(spark, 3000, 100)
    model, index = built(spark, docs, cells=32)
    many = questions.select(F.explode(F.sequence(F.col("question_id") * 40, F.col("question_id") * 40 + 39)).alias("question_id"), "embedding")
    plan = vi.indexed_topk(many, index, model)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    few_rows, many_rows = ({(x.question_id if q is questions else x.question_id // 40, x.doc_id) for x in vi.indexed_topk(q, index, model).collect()} for q in (questions, many))
    assert few_rows == many_rows


def test_odd_tables(spark):
    none = spark.createDataFrame([], DOCS)
    questions = spark.createDataFrame([(1, [1.0] * 32), (2, None)], "question_id long, embedding array<double>")
    assert vi.fit_index(none).cells.shape == (1, 0)
    docs = spark.createDataFrame([(7, "a", [1.0] + [0.0] * 31), (7, "a", [1.0] + [0.0] * 31), (8, "a", None), (9, None, [1.0] * 32)], DOCS)
    model, index = built(spark, docs)
    assert [(r.question_id, r.doc_id) for r in vi.indexed_topk(questions, index, model).orderBy("collection", "rank").collect()] == [(1, 9), (1, 7), (1, 7)]


def listed(index):
    """(collection, cell, part, ids, codes) of all parts."""
    return sorted((r.collection, r.cell, r.part, tuple(r.ids), bytes(r.codes), bytes(r.vectors)) for r in index.collect())


def test_updates_equal_an_index_from_scratch(spark):
    """Three micro-batches with new, changed, moved and deleted documents, one of them repeated."""
    vectors = clustered(5, 900)
    row = lambda i, v, collection="a", deleted=False: (i, collection, v.tolist(), deleted)
    schema = DOCS + ", deleted boolean"
    first = [row(i, vectors[i], "ab"[i % 2]) for i in range(500)]
    batches = [[row(i, vectors[i], "ab"[i % 2]) for i in range(500, 700)] + [row(3, vectors[703], "b"), row(4, vectors[4], "a", True)],
               [row(i, vectors[i + 100], "b") for i in range(100, 140)] + [row(i, vectors[i], "a", True) for i in range(200, 260)],
               [row(4, vectors[800], "a"), row(9999, vectors[0], "a", True), row(600, vectors[600], "a", True)]]
    start = spark.createDataFrame(first, schema)
    model, index = built(spark, start, cells=24)
    path = scratch_path(spark, "kept-index")
    vi.build_index(start, model, path, part=32)
    now = {r[0]: r for r in first}
    for batch in [*batches, batches[-1]]:
        now.update({r[0]: r for r in batch})
        vi.update_index(spark.createDataFrame(batch, schema), model, path, part=32)
        rest = [r for r in now.values() if not r[3]]
        scratch = scratch_path(spark, "scratch-index")
        vi.build_index(spark.createDataFrame(rest, schema), model, scratch, part=32)
        assert listed(vi.read_index(spark, path)) == listed(vi.read_index(spark, scratch))
    vi.update_index(spark.createDataFrame([(*r[:3], True) for r in now.values()], schema), model, path, part=32)
    assert vi.read_index(spark, path).count() == 0


def returned(df):
    """Rows that each step in Python returned, once the table has been collected."""
    plans, found = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "MapInArrowExec":
            found.append(plan.metrics().apply("pythonNumRowsReceived").value())
        inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
        plans += [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_candidates_do_not_grow_with_the_parts(spark):
    """Parts return what can be among the survivors of a question, not as many candidates as a question may have."""
    docs, questions = tables(spark, 6000, 60)
    docs = docs.withColumn("collection", F.when(F.col("doc_id") % 3 > 0, F.col("collection")))  # a third has none
    _, whole = built(spark, docs, cells=8, part=10**6)
    model, index = built(spark, docs, cells=8, part=16)
    assert index.count() > 300
    found = vi.indexed_topk(questions, index, model, probes=8, survivors=12, min_score=-1.0)
    got = rows(found.withColumn("collection", F.coalesce("collection", F.lit(""))))
    found.collect()
    assert 60 * 3 * 12 <= max(returned(found)) < 60 * 3 * 12 * 8
    # the best codes of all lists, then the best scores among them
    lists = [(r.collection or "", r.ids, model.decode(np.frombuffer(r.codes, np.uint8).reshape(-1, 16), r.cell), np.frombuffer(r.vectors).reshape(len(r.ids), -1)) for r in whole.collect()]
    want = []
    for q in questions.collect():
        for name in ("", "a", "b"):
            ids, codes, vectors = (np.concatenate([x[i] for x in lists if x[0] == name]) for i in (1, 2, 3))
            best = np.argsort(-(codes @ q.embedding))[:12]
            scores = np.round(vectors[best] @ q.embedding, 4)
            want += [(q.question_id, name, n + 1, int(ids[best[i]]), scores[i]) for n, i in enumerate(np.lexsort((ids[best], -scores))[:5])]
    assert got == sorted(want)


def test_scores_that_reach_a_floor():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(700, 16)), rng.normal(size=(1500, 16))
    b[200:900] = b[200]  # copies
    b[5, 0], a[3] = np.nan, 0.0
    exact = a @ b.T
    levels = vi._levels(a, b, 64)
    floor = np.where(np.arange(700) % 3 == 0, -np.inf, levels[:, -1])
    for scale in (1.0, 1e25):  # the second is beyond single precision
        row, col, score = vi._reaching(a * scale, b * scale, floor * scale ** 2, 64)
        for i in range(700):
            mine = row == i
            assert mine.sum() == 64 and 5 not in col[mine]
            assert np.allclose(np.sort(score[mine]) / scale ** 2, np.sort(np.where(np.isfinite(exact[i]), exact[i], -np.inf))[-64:])
    assert len(vi._reaching(a, b[:0], floor, 64)[0]) == 0 and vi._levels(a, b[:3], 64).shape == (700, 0)
    with np.errstate(invalid="ignore"):
        assert (levels <= np.sort(np.where(np.isfinite(exact), exact, -np.inf), axis=1)[:, ::-1][:, 3:64:4]).all()
