import math

import numpy as np
import pytest

from clausemill.operators import retrieval, vector_search
from clausemill.operators.vector_search import VectorIndex

ROWS = "lease_id string, chunk_id int, embedding array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture
def clustered(spark):
    """Four hundred vectors around twenty centres, in two leases of unequal size, with odd ones among them."""
    rng = np.random.default_rng(3)
    centres = unit(rng.standard_normal((20, 16)))
    x = unit(centres[rng.integers(20, size=400)] + 0.08 * rng.standard_normal((400, 16)))
    rows = [("a" if k % 10 else "b", k, [float(c) for c in v]) for k, v in enumerate(x)]
    odd = [("a", 900, None), ("a", 901, []), ("a", 902, [0.0] * 16), ("a", 903, [1.0] * 5), ("b", 904, [None] + [1.0] * 15)]
    return spark.createDataFrame(rows + odd, ROWS)


def test_tiles_give_the_rows_of_the_exact_search(spark, clustered):
    asks = clustered.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = retrieval.dense_topk(asks, clustered, 6)
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.distance, 6), r["rank"]) for r in df.collect())
    tiles = vector_search.tiled_topk(asks, clustered, 6, questions=10, vectors=30)
    assert rows(tiles) == rows(exact)
    itself = vector_search.tiled_topk(asks, clustered, 3, itself=True, questions=8, vectors=50)
    assert rows(itself) == rows(retrieval.dense_topk(asks, clustered, 3, itself=True))


def test_many_questions_use_tiles_and_several_tasks(spark, clustered, monkeypatch):
    asks = clustered.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    few = {(r.query_id, r.chunk_id) for r in retrieval.dense_topk(asks, clustered).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    many = retrieval.dense_topk(asks, clustered)
    assert {(r.query_id, r.chunk_id) for r in many.collect()} == few
    assert "FlatMapCoGroups" in many._jdf.queryExecution().executedPlan().toString()
    one = clustered.where("lease_id = 'a'")
    found = vector_search.tiled_topk(one.withColumnRenamed("chunk_id", "query_id"), one, 2, questions=40, vectors=40)
    assert found.count() == 2 * one.count()


def test_no_questions_or_vectors(spark, clustered):
    asks = clustered.withColumnRenamed("chunk_id", "query_id")
    for a, b in ((asks.limit(0), clustered), (asks, clustered.limit(0))):
        assert vector_search.tiled_topk(a, b, 3).count() == 0 and retrieval.dense_topk_approx(a, b).count() == 0
        assert vector_search.similar_pairs(a.withColumnRenamed("query_id", "request_id"), b.withColumnRenamed("chunk_id", "answer_id"), 0.9, ["lease_id"]).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.92, 0.999])
@pytest.mark.parametrize("pivots", [1, 5, 40])
def test_angle_bounds_lose_no_pair(spark, clustered, least, pivots):
    asks = clustered.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "request_id")
    have = clustered.withColumnRenamed("chunk_id", "answer_id")
    found = {(r.request_id, r.answer_id) for r in vector_search.similar_pairs(asks, have, least, ["lease_id"], pivots=pivots).collect()}
    rows = [(r.lease_id, r.chunk_id, r.embedding) for r in clustered.collect()]
    good = [(g, i, unit(np.array(v))) for g, i, v in rows if v is not None and len(v) == 16 and None not in v and any(v)]
    expected = {(i, j) for g, i, v in good if i % 9 == 0 for h, j, w in good if g == h and v @ w >= least}
    assert {(i, j) for i, j in found if i < 900 and j < 900} == expected
    if pivots == 40 and least == 0.92:
        compared = vector_search.angle_candidates(asks, have, least, ["lease_id"], pivots=pivots).count()
        everything = asks.join(have, "lease_id").count()
        print(f"{compared} of {everything} pairs are compared for {len(expected)} found")
        assert compared < everything / 4


def test_no_self_match_and_first_of_equals(spark):
    from clausemill.operators.answers import semantic_answer_lookup

    t = math.acos(0.92)
    at = lambda a: [math.cos(a), math.sin(a)]
    have = spark.createDataFrame([(1, "l", "f", at(0.0)), (2, "l", "f", at(0.1)), (3, "l", "f", at(-0.1)), (4, "l", "f", at(t + 0.05))], "answer_id int, lease_id string, flags string, embedding array<double>")
    asks = have.withColumnRenamed("answer_id", "request_id")
    assert {r.request_id: r.answer_id for r in semantic_answer_lookup(asks, have, itself=False).collect()} == {1: 2, 2: 1, 3: 1, 4: 2}
    assert {r.request_id: r.answer_id for r in semantic_answer_lookup(asks, have).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_stored_vectors(spark, clustered, tmp_path):
    asks = clustered.where("chunk_id % 7 = 0 and chunk_id < 900").withColumnRenamed("chunk_id", "query_id")
    index = VectorIndex(spark, str(tmp_path), chunk="int", buckets=2)
    index.fit(clustered, cells=20)
    index.update(clustered.where("chunk_id % 2 = 0"), 0)
    index.update(clustered, 1)
    assert index.store.read("vectors").count() == clustered.count()
    centres, probes = VectorIndex(spark, str(tmp_path), chunk="int", buckets=2).centres()
    assert len(centres) == 20 and 1 <= probes <= 20
    exact = {(r.query_id, r.chunk_id) for r in retrieval.dense_topk(asks, clustered).collect()}
    found = {(r.query_id, r.chunk_id) for r in index.search(asks, retrieval.TOP).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    everywhere = {(r.query_id, r.chunk_id) for r in index.search(asks, retrieval.TOP, probes=20).collect()}
    # vectors that cannot be compared lie in some cell too
    assert everywhere == exact


def test_sides_of_tiles_grow_with_the_counts(spark, clustered, monkeypatch):
    """Tiles of a few rows at first: no vector is sent for more than MOST_BLOCKS blocks of questions, unless a block has as many bytes as it may."""
    monkeypatch.setattr(vector_search, "MOST_BLOCKS", (2, 3))
    sent, saved = [], vector_search.saved
    monkeypatch.setattr(vector_search, "saved", lambda df, name: sent.append(saved(df, name)) or sent[-1])
    asks = clustered.withColumnRenamed("chunk_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.distance, 6), r["rank"]) for r in df.collect())
    exact = rows(retrieval.dense_topk(asks, clustered, 4))
    assert rows(vector_search.tiled_topk(asks, clustered, 4, questions=5, vectors=7)) == exact
    assert max((r.q_blocks, r.c_blocks) for r in sent[-1].collect()) == (2, 3)
    monkeypatch.setattr(vector_search, "SIDE_BYTES", 8 * 16 * 20)
    assert rows(vector_search.tiled_topk(asks, clustered, 4, questions=5, vectors=7)) == exact
    assert max(r.q_blocks for r in sent[-1].collect()) > 15


def test_many_questions_are_multiplied(spark, clustered, monkeypatch, tmp_path):
    """A few are compared one by one; more become tiles in both searches, with the same rows."""
    asks = clustered.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "query_id")
    index = VectorIndex(spark, str(tmp_path / "vectors"), "string", "int", buckets=2)
    index.fit(clustered, cells=8)
    index.update(clustered, 0)
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.distance, 6), r["rank"]) for r in df.collect())
    searches = (lambda: retrieval.dense_topk(asks, clustered), lambda: index.search(asks, 5, probes=3))
    few = [rows(search()) for search in searches]
    monkeypatch.setattr(retrieval, "BROADCAST_ASKS", 10)
    for search, expected in zip(searches, few, strict=True):
        found = search()
        assert rows(found) == expected and "FlatMapCoGroups" in found._jdf.queryExecution().executedPlan().toString()
