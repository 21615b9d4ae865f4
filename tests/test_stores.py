import pytest
from pyspark.sql import functions as F

from clausemill.operators import leases, requests, retrieval
from clausemill.operators.lexical_index import LexicalIndex
from clausemill.operators.retention import Retention
from clausemill.sources import tables, validate
from clausemill.sources.store import LeaseStore

CHUNKS = "lease_id string, chunk_id int, text string"


def scores(spark, index, asked):
    return sorted((r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in retrieval.bm25_topk(asked, index, 5).collect())


def test_a_reingest_equals_a_rebuild(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, "rent is due monthly"), ("a", 2, "the roof"), ("b", 3, "rent rent and roof"), ("c", 4, "")], CHUNKS)
    again = spark.createDataFrame([("a", 1, "the tenant pays rent"), ("a", 5, "roof and walls"), ("a", 6, "")], CHUNKS)
    asked = spark.createDataFrame([(1, "rent roof", "a"), (2, "rent the", "b"), (3, "rent", "c")], "query_id int, question string, lease_id string")
    index = LexicalIndex(spark, str(tmp_path), chunk="int", buckets=2)
    index.update(first, 0)
    assert scores(spark, index.read(), asked) == scores(spark, retrieval.build_bm25(first), asked)
    index.update(again, 1)
    whole = again.unionByName(first.where("lease_id <> 'a'"))
    assert scores(spark, index.read(), asked) == scores(spark, retrieval.build_bm25(whole), asked)
    index.remove(first.where("lease_id = 'b'").select("lease_id"), 2)
    index.compact(most=1)
    assert scores(spark, index.read(), asked) == scores(spark, retrieval.build_bm25(whole.where("lease_id <> 'b'")), asked)
    some = index.read(whole.where("lease_id = 'c'"))
    assert some.chunks.where("lease_id = 'c'").count() == 1


def test_part_of_a_batch_is_not_seen(spark, tmp_path):
    """Rows that were put before the leases of their batch, as by a job that died, do not count."""
    store = LeaseStore(spark, str(tmp_path), {"rows": "lease_id string, n int"}, 2)
    rows = lambda *r: spark.createDataFrame(r, "lease_id string, n int")
    store.write(0, rows(("a", 1), ("b", 1)), rows=rows(("a", 1), ("b", 1)))
    store.put(1, "rows", rows(("a", 2)))
    assert sorted(map(tuple, store.read("rows").collect())) == [("a", 1), ("b", 1)]
    store.write(1, rows(("a", 3)), rows=rows(("a", 3)))
    assert sorted(map(tuple, store.read("rows").collect())) == [("a", 3), ("b", 1)]
    assert sorted(map(tuple, store.read("rows", before=1).collect())) == [("a", 1), ("b", 1)]
    assert store.read("rows", []).count() == 0 and LeaseStore(spark, f"{tmp_path}/none", store.kinds).read("rows").count() == 0


@pytest.mark.parametrize("dies_at", [1, 2, 3])
def test_a_sweep_that_died_goes_on(spark, tmp_path, dies_at):
    ids = spark.createDataFrame([("old", "2024-01-01"), ("bad", "2024-01-02"), ("new", "2024-03-01"), ("odd", None)], "lease_id string, created_at string")
    items = spark.createDataFrame([("old", 1), ("old", 2), ("bad", 3), ("new", 4), ("odd", 5)], "lease_id string, n int")
    stores = {k: LeaseStore(spark, f"{tmp_path}/{k}", {k: s}, 2) for k, s in (("chunks", "lease_id string, n int"), ("answers", "lease_id string, n int"), ("records", "lease_id string, created_at string"))}
    for k, rows in (("chunks", items), ("answers", items), ("records", ids)):
        stores[k].write(0, rows, **{k: rows})
    calls = {"n": 0}

    class Dies(LeaseStore):
        def remove(self, rows, batch_id):
            super().remove(rows, batch_id)
            calls["n"] += 1
            if calls["n"] == dies_at:
                raise RuntimeError("lost")

    for store in stores.values():
        store.__class__ = Dies
    sweep = Retention(spark, f"{tmp_path}/journal", {k: stores[k] for k in ("chunks", "answers")}, stores["records"])
    failures = spark.createDataFrame([("bad", "answers", "down")], "lease_id string, step string, error string")
    with pytest.raises(RuntimeError, match="lost"):
        sweep.sweep(0, "2024-03-02", 30, failures)
    for _ in range(2):  # the second changes nothing
        report = {r.lease_id: (r.n_chunks, r.n_answers, list(r.errors), r.succeeded) for r in sweep.sweep(0, "2024-03-02", 30, failures).collect()}
        assert report == {"old": (2, 2, [], True), "bad": (1, 0, ["answers: down"], False)}
        assert sorted(r.lease_id for r in stores["records"].read("records").collect()) == ["bad", "new", "odd"]
        assert sorted(r.n for r in stores["chunks"].read("chunks").collect()) == [4, 5] and sorted(r.n for r in stores["answers"].read("answers").collect()) == [3, 4, 5]
    assert {r.lease_id: (r.n_chunks, r.n_answers, r.succeeded) for r in sweep.sweep(1, "2024-03-02", 30).collect()} == {"bad": (0, 1, True)}
    assert sorted(r.lease_id for r in stores["records"].read("records").collect()) == ["new", "odd"]


def test_lists_and_lookups_of_leases(spark):
    known = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-03-01"), ("c", None), ("d", "2024-03-01")], "lease_id string, created_at string")
    page, total = leases.list_leases(known, 1, 3)
    assert [r.lease_id for r in page.collect()] == ["b", "d", "a"] and total == 4
    wanted = spark.createDataFrame([("a",), ("z",), ("a",)], "lease_id string")
    assert sorted(map(tuple, leases.get_leases(known, wanted).collect())) == [("a", "2024-01-01"), ("z", None)]


def test_default_signals(spark):
    hits = {"Tenant  signature: x": 0, "APPROVED OCCUPANTS": 0, "name : Ann": 0, "base rent": 1, "commences": 1, "Expiration": 1, "premises located": 1, "the lessee": 2, "rental": None, "signed": None, "surname here": None}
    rows = spark.createDataFrame([(t,) for t in hits], "t string").select("t", *(F.col("t").rlike(p).alias(f"s{k}") for k, p in enumerate(leases.SIGNALS))).collect()
    assert {r.t: next((k for k in range(3) if r[f"s{k}"]), None) for r in rows} == hits


def test_metadata_fields(spark):
    long = "x" * 200
    df = spark.createDataFrame([(f" {long} ", None), (long + "x", "y" * 201), ("", " " * 300)], "tenant string, landlord string")
    assert [r.errors for r in validate.metadata_fields(df, ("tenant", "landlord")).collect()] == [[], ["tenant", "landlord"], []]


def test_uploads_are_read_as_they_are(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"PK\x03\x04")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    rows = validate.gate_uploads(tables.read_uploads(spark, str(tmp_path))).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.length, r.reason) for r in rows} == {"a.PDF": (10, None), "b.pdf": (4, "signature"), "c.txt": (4, "type")}


def test_sketches_merge(spark):
    df = spark.range(20_000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 30).alias("ts"), ((F.col("id") * 7919) % 20_000).cast("double").alias("latency_ms"), (F.col("id") % 2).cast("string").alias("status"))
    days = requests.latency_sketches(df, "status")
    assert days.groupBy("status").count().first()["count"] > 5
    for r in requests.merged_quantile(days, "status").collect():
        assert r.n == 10_000 and abs(r.quantile_ms / 20_000 - 0.95) < 2 * requests.RANK_ERROR


def test_few_files_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert tables.spread(rows) is rows
    assert tables.spread(rows, least=1).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 64)
    assert tables.spread(many, least=0) is many


def test_terms_are_counted_in_their_rows(spark, tmp_path):
    """Postings are shuffled once, to their parts; rows that share an id are one chunk."""
    rows = [("a", 1, "b a b. A c"), ("a", 2, ""), ("a", 3, None), ("b", 1, "z§ z§")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    from clausemill.operators.lexical_index import counted

    found = counted(chunks)
    assert sorted(((*r,) for r in found.collect()), key=repr) == sorted([("a", "a", 1, 5, 2), ("a", "b", 1, 5, 2), ("a", "c", 1, 5, 1), ("a", None, 2, 0, 0), ("a", None, 3, 0, 0), ("b", "z§", 1, 2, 2)], key=repr)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    again = retrieval.build_bm25(chunks.unionByName(chunks.where("chunk_id = 1")))
    assert {(r.lease_id, r.chunk_id, r.term): r.tf for r in again.tf.collect()} == {("a", 1, "a"): 4, ("a", 1, "b"): 4, ("a", 1, "c"): 2, ("b", 1, "z§"): 4}
    assert again.chunks.count() == 4


def test_terms_of_texts_are_counted_in_arrow():
    import re
    from collections import Counter

    import pyarrow as pa

    from clausemill.functions.text import TOKEN
    from clausemill.operators.lexical_index import tokens_of

    texts = ["b a b. a c", "", " ", "§§ ¢§aă§b", "é§ x\n\0y\tz\x0bz a--a", " x\x85", "b"]
    for kind in (pa.string(), pa.large_string()):
        for start, n in ((0, 7), (1, 4), (1, 2), (0, 0)):  # slices keep their buffers
            some = pa.array(texts, kind).slice(start, n)
            row, terms, at = tokens_of(some)
            assert terms.to_pylist() == sorted(terms.to_pylist())
            found = Counter(zip(row.tolist(), terms.take(pa.array(at)).to_pylist()))
            assert found == Counter((i, t) for i, text in enumerate(some.to_pylist()) for t in re.findall(TOKEN, text))


def test_postings_are_not_sorted_and_terms_are_shuffled_once(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, "b a b c"), ("a", 2, "c d"), ("b", 1, "a")], CHUNKS)
    index = LexicalIndex(spark, str(tmp_path), chunk="int", buckets=2)
    shuffled, put = {}, index.store.put

    def seen(batch_id, kind, rows, order=("lease_id",), part=None, few=False):
        shuffled[kind] = not few
        put(batch_id, kind, rows, order, part, few)

    index.store.put = seen
    index.update(chunks, 0)
    assert not shuffled["chunks"] and not shuffled["terms"]  # no shuffle but that of their count
    postings = index.read().postings()
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.lease_id, r.term, r.chunk_id) for r in postings.collect()) == [("a", "a", 1), ("a", "b", 1), ("a", "c", 1), ("a", "c", 2), ("a", "d", 2), ("b", "a", 1)]
