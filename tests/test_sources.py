import json

import pytest
from pyspark.sql import functions as F

from clausemill.operators import chunking
from clausemill.sources import tables, validate


def test_read_pages_keeps_empty_pages(spark, tmp_path):
    (tmp_path / "lease1.txt").write_text("one\f\fthree")
    rows = tables.read_pages(spark, str(tmp_path)).orderBy("page").collect()
    assert [(r.lease_id, r.source, r.page, r.text) for r in rows] == [("lease1", "lease1.txt", 1, "one"), ("lease1", "lease1.txt", 2, ""), ("lease1", "lease1.txt", 3, "three")]


def test_textless(spark):
    blank = "\u00a0\u2003\u3000\x85\x1f\n"
    df = spark.createDataFrame([("a", " x "), ("b", " "), ("b", None), ("c", blank), ("d", f"{blank}y{blank}z{blank}")], "lease_id string, text string")
    good, bad = validate.split_textless(df)
    assert good.count() == 2 and sorted(r.lease_id for r in bad.collect()) == ["b", "c"]
    assert {r.lease_id: r.n_chars for r in validate.textless(df).collect()} == {"a": 1, "b": 0, "c": 0, "d": 8}


def test_gate_uploads(spark):
    rows = [("p1", 4, bytearray(b"%PDF"), "application/pdf"), ("p2", 4, bytearray(b"ZIP!"), "application/pdf"), ("p3", 4, bytearray(b"%PDF"), "text/plain"), ("p4", 60 * 2**20, bytearray(b"%PDF"), "application/pdf"), ("p5", 0, bytearray(), "application/pdf")]
    df = spark.createDataFrame(rows, "path string, length long, content binary, mime string")
    assert {r.path: r.reason for r in validate.gate_uploads(df).collect()} == {"p1": None, "p2": "signature", "p3": "type", "p4": "size", "p5": "signature"}


def test_validate_pairs(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("a b", None)], "left_id string, right_id string")
    assert [r.errors for r in validate.pairs(df).collect()] == [[], ["same_lease"], ["left_id", "right_id"]]


def test_read_golden(spark, tmp_path):
    row = {"question": "q", "relevant_clause_ids": ["x::1"], "reference_answer": "a", "category": "factual", "should_refuse": False}
    (tmp_path / "g.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"category": "statute"}))
    assert tables.read_golden(spark, str(tmp_path / "g.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text(json.dumps(row | {"category": "nope"}))
    with pytest.raises(Exception, match="unknown category"):
        tables.read_golden(spark, str(tmp_path / "bad.jsonl")).collect()


def test_json_store(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": "a", "n": 1}\n{broken\n')
    rows, corrupt = tables.read_json_store(spark, str(tmp_path / "s.json"), "id string, n int")
    assert [(r.id, r.n) for r in rows.collect()] == [("a", 1)] and corrupt.first().corrupt == 1


def test_upsert_replaces_a_lease(spark, tmp_path):
    path = str(tmp_path / "chunks")
    df = lambda lease, n: spark.range(n).select(F.lit(lease).alias("lease_id"), F.col("id").alias("chunk_no"))
    tables.upsert_chunks(df("a", 5).union(df("b", 2)), path)
    tables.upsert_chunks(df("a", 1), path)
    assert {r.lease_id: r["count"] for r in spark.read.parquet(path).groupBy("lease_id").count().collect()} == {"a": 1, "b": 2}


def test_ingest_summary(spark):
    chunks = spark.createDataFrame([("a",), ("a",)], "lease_id string")
    leases = spark.createDataFrame([("a",), ("b",)], "lease_id string")
    assert {r.lease_id: (r.chunk_count, r.accepted) for r in chunking.ingest_summary(chunks, leases).collect()} == {"a": (2, True), "b": (0, False)}


def test_drops_are_written_after_one_shuffle(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from clausemill.plans.chunk_queries import a1_read_pages

    seen, text = [], DataFrameWriter.text

    def spied(self, path, **options):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        text(self, path, **options)

    monkeypatch.setattr(DataFrameWriter, "text", spied)
    rows = a1_read_pages(spark, "/root/testdata/sf0.001").collect()
    assert seen == [1] and len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
