import math

import pytest
from pyspark.sql import functions as F

from clausemill.functions.vectors import cosine
from clausemill.operators import retrieval


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r.c for r in df.select(cosine("a", "b").alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def plain_bm25(texts, query):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    terms = {w for d in docs for w in d}
    raw = {w: math.log(n - (df := sum(w in d for d in docs)) + 0.5) - math.log(df + 0.5) for w in terms}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.split()) for d in docs]


def test_bm25_against_plain(spark):
    texts = ["rent due monthly rent", "the tenant pays the rent", "the landlord repairs the roof", "the end", "nothing here"]
    chunks = spark.createDataFrame([("l", i, t) for i, t in enumerate(texts)], "lease_id string, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "rent rent the", "l"), (2, "absent", "l")], "query_id int, question string, lease_id string")
    rows = retrieval.bm25_topk(asked, retrieval.build_bm25(chunks), 10).collect()
    expected = plain_bm25(texts, "rent rent the")
    got = {r.chunk_id: r.score for r in rows if r.query_id == 1}
    assert len(got) == 5 and all(abs(got[i] - expected[i]) < 1e-9 for i in got)
    assert [r.chunk_id for r in sorted((r for r in rows if r.query_id == 2), key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]


def test_fuse(spark):
    dense = spark.createDataFrame([(1, "a", 0.1, 1), (1, "b", 0.5, 2)], "query_id int, chunk_id string, distance double, rank int")
    lexical = spark.createDataFrame([(1, "b", 4.0, 1), (1, "c", 2.0, 2)], "query_id int, chunk_id string, score double, rank int")
    get = lambda alpha: [(r.chunk_id, round(r.distance, 6)) for r in retrieval.fuse(dense, lexical, alpha).orderBy("rank").collect()]
    assert get(0.5) == [("a", 0.5), ("b", 0.5), ("c", 1.0)]
    assert get(1.0)[0] == ("a", 0.0) and get(0.0)[0] == ("b", 0.0)
    single = dense.where("chunk_id = 'a'")
    assert [r.distance for r in retrieval.fuse(single, lexical.limit(0)).collect()] == [1.0]


def test_gate(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 0.55), (2, 0.5501)], "query_id int, distance double")
    got = {r.query_id: (r.refused, round(r.confidence, 4)) for r in retrieval.refusal_gate(asked, hits).collect()}
    assert got == {1: (False, 0.45), 2: (True, 0.0), 3: (True, 0.0)}
    hits = spark.createDataFrame([(2, 1, None, 0.9)], "query_id int, rank int, clause_type string, distance double")
    counts = retrieval.refusals_by_clause(retrieval.refusal_gate(asked.where("query_id > 1"), hits), hits)
    assert {r.clause_type: r.refusals for r in counts.collect()} == {"other": 1, "unknown": 1}


def test_hybrid_needs_rerank(spark):
    asked = spark.createDataFrame([(1, "q", "l")], "query_id int, question string, lease_id string")
    with pytest.raises(ValueError, match="rerank"):
        retrieval.retrieve(asked, asked, "hybrid")


def test_approximate_recall(spark):
    from clausemill.plans.bindings import vectors

    sf = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.chunk_id) for r in retrieval.dense_topk(*vectors(spark, sf)).collect()}
    near = {(r.query_id, r.chunk_id) for r in retrieval.dense_topk_approx(*vectors(spark, sf)).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_dense_topk_broadcasts_queries(spark):
    from clausemill.plans.bindings import vectors

    plan = retrieval.dense_topk(*vectors(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_normalize_all_equal(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 4.0)], "query_id int, s double")
    assert sorted((r.query_id, r.scaled) for r in retrieval.normalize(df, "s").collect()) == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0)]
    assert F is not None


def test_dense_lengths_and_zeros(spark):
    rows = [(1, "l", [1.0, 0.0, 0.0]), (2, "l", [1.0, 1.0]), (3, "l", [0.0, 0.0, 0.0]), (4, "l", []), (5, "l", [2.0, 0.0, 0.0]), (6, "l", [0.0, 3.0, 4.0]), (7, "m", [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id int, lease_id string, embedding array<float>")
    asks = spark.createDataFrame([(10, "l", [2.0, 0.0, 0.0]), (11, "l", [1.0, 0.0])], "query_id int, lease_id string, embedding array<float>")
    got = {(r.query_id, r.chunk_id): round(r.distance, 6) for r in retrieval.dense_topk(asks, vectors, 10).collect()}
    assert got == {(10, 1): 0.0, (10, 2): 1.0, (10, 3): 1.0, (10, 4): 1.0, (10, 5): 0.0, (10, 6): 1.0} | {(11, k): 1.0 for k in (1, 3, 4, 5, 6)} | {(11, 2): round(1 - 0.5**0.5, 6)}
    assert retrieval.dense_topk(asks.limit(0), vectors).count() == 0


def test_a_search_sends_on_the_best_of_blocks(spark):
    """Pairs of question and chunk are no rows: a block of chunks sends on its ``k`` best of each question, of copies the smaller ids."""
    texts = ["rent due monthly rent", *["the tenant pays the rent"] * 60, "nothing here"]
    chunks = spark.createDataFrame([("l", i, t) for i, t in enumerate(texts)] + [("m", 99, "rent")], "lease_id string, chunk_id int, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "tenant tenant", "l"), (2, "rent due", "l")], "query_id int, question string, lease_id string")
    index = retrieval.build_bm25(chunks)
    terms = index.idf.join(spark.createDataFrame([("l", "tenant", 1, 2), ("l", "rent", 2, 1), ("l", "due", 2, 1)], "lease_id string, term string, query_id int, times long"), ["lease_id", "term"])
    found = retrieval.best_in_blocks(index, terms.toArrow(), 2, "int")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() <= 4 * index.rows.rdd.getNumPartitions() < len(texts)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieval.bm25_topk(asked, index, 3).collect()}
    expected = {q: sorted(((-round(s, 9), i) for i, s in enumerate(plain_bm25(texts, words))))[:3] for q, words in ((1, "tenant tenant"), (2, "rent due"))}
    assert all(got[q, n + 1][0] == i and abs(got[q, n + 1][1] + s) < 1e-8 for q, rows in expected.items() for n, (s, i) in enumerate(rows))


def test_refusals_fetch_texts_once(spark):
    """The hits that the gate and the count read are written first, so the result reads no documents."""
    from clausemill.plans.retrieval_queries import d13_refusals_by_clause
    from oracle import SF

    found = d13_refusals_by_clause(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "hits-" in plan
