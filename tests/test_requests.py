import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clausemill.operators import requests
from clausemill.streaming import jobs

START = dt.datetime(2024, 1, 1)
SCHEMA = "request_id long, client_key string, ts timestamp, latency_ms double, status string"


def log(spark):
    """Client a: 31 within a minute and more after it; b: calm; c: exactly 60 s apart."""
    rows, n = [], 0
    for client, seconds in (("a", [k for k in range(40)] + [59.5, 60, 61, 90, 121]), ("b", [0, 50, 200]), ("c", [0, 60, 120])):
        for s in seconds:
            rows.append((n, client, START + dt.timedelta(seconds=s), float(s * 7), "ok" if n % 3 else "error"))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows, limit, seconds):
    out, logs = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.request_id)):
        own = [t for t in logs.get(r.client_key, []) if (r.ts - t).total_seconds() < seconds]
        ok = len(own) < limit
        wait = None if ok else max(1, int(seconds - (r.ts - own[0]).total_seconds()) + 1)
        logs[r.client_key] = own + [r.ts] if ok else own
        out[r.request_id] = (ok, wait)
    return out


def test_rate_limit_against_a_loop(spark):
    df = log(spark)
    for limit in (1, 3, 30):
        got = {r.request_id: (r.allowed, r.retry_after) for r in requests.rate_limit(df, limit).collect()}
        assert got == plain(df.collect(), limit, 60)
    over = requests.over_limit_windows(df, 30).where("over").select("request_id")
    refused = requests.rate_limit(df, 30).where("not allowed").select("request_id")
    assert refused.exceptAll(over).count() == 0


def test_rate_limit_against_a_loop_on_events(spark):
    from clausemill.plans.bindings import requests as bound

    df = bound(spark, "/root/testdata/sf0.01")
    got = {r.request_id: (r.allowed, r.retry_after) for r in requests.rate_limit(df, 3, 86_400).collect()}
    assert got == plain(df.collect(), 3, 86_400) and not all(ok for ok, _ in got.values())


def test_client_key(spark):
    df = spark.createDataFrame([(" 1.1.1.1 , 2.2.2.2", "h", 1), (None, "h", 2), (" ", None, 3)], "forwarded_for string, host string, request_id long")
    assert [r.k for r in df.select(requests.client_key().alias("k")).collect()] == ["1.1.1.1", "h", "unknown-3"]


def _streamed(spark, tmp_path, build, name):
    df = log(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = build(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return df, spark.table(name)


def test_rate_limit_stream_over_batches(spark, tmp_path):
    """Three files, out of order within the watermark; a last row far ahead lets the watermark pass all others."""
    df = log(spark)
    late = F.when(F.col("request_id") % 4 == 1, 15).otherwise(0) + F.unix_seconds("ts") - int(START.replace(tzinfo=dt.UTC).timestamp())
    parts = [df.where((late >= a) & (late < b)) for a, b in ((0, 40), (40, 80), (80, 10**6))]
    assert all(p.count() for p in parts)
    end = spark.createDataFrame([(99, "z", START + dt.timedelta(hours=1), 0.0, "ok")], SCHEMA)
    for p in [*parts, end]:
        p.orderBy(F.col("ts").desc()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for limit in (3, 30):
        out = jobs.to_table(requests.rate_limit_stream(stream, limit, late="20 seconds"), str(tmp_path / f"out{limit}"), str(tmp_path / f"cp{limit}"))
        got = {r.request_id: (r.allowed, r.retry_after) for r in out.collect()}
        assert got == {r.request_id: (r.allowed, r.retry_after) for r in requests.rate_limit(df, limit).collect()}


def test_a_timer_reads_and_writes_a_clients_state_once():
    """And a second timer of the same batch, when all that is due is decided, writes nothing."""
    calls, state, timers = [], [], []

    class State:
        def get(self):
            calls.append("get")
            return iter(list(state))

        def put(self, rows):
            calls.append("put")
            state[:] = rows

        def appendList(self, rows):  # noqa: N802
            calls.append("append")
            state.extend(rows)

        def clear(self):
            calls.append("clear")
            state.clear()

    handle = SimpleNamespace(getListState=lambda *_: State(), registerTimer=timers.append)
    limiter = requests.Limiter(1, 60)
    limiter.init(handle)
    second = 1_000_000
    rows = [SimpleNamespace(us=s * second, request_id=i) for i, s in ((1, 5), (0, 0), (2, 100))]
    assert list(limiter.handleInputRows(("a",), iter(rows), None)) == [] and timers == [1]
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    decided = [tuple(r) for r in limiter.handleExpiredTimer(("a",), at(50_000), None)]
    assert decided == [(0, "a", True, None), (1, "a", False, 56)]
    assert list(limiter.handleExpiredTimer(("a",), at(50_000), None)) == []
    assert calls == ["append", "get", "put", "get"]
    assert [tuple(r) for r in limiter.handleExpiredTimer(("a",), at(200_000), None)] == [(2, "a", True, None)]
    assert state == [] and calls[4:] == ["get", "clear"]


def test_late_rows_are_those_the_stream_drops(spark, tmp_path):
    rows = [(0, 5), (0, 70), (1, 65), (1, 3), (1, 200), (2, 59), (2, 130), (2, 300), (3, 100), (3, 400)]
    df = spark.createDataFrame([(b, START + dt.timedelta(seconds=s), "ok") for b, s in rows], "batch int, ts timestamp, status string")
    for b in range(4):
        df.where(F.col("batch") == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = jobs.to_table(jobs.outcome_windows(stream, []), str(tmp_path / "out"), str(tmp_path / "cp"))
    minutes = {r.start: (r.counted, r.dropped, r.pending) for r in jobs.late_rows(df, counted).collect()}
    minute = lambda k: START + dt.timedelta(minutes=k)
    # a batch drops what the watermark of the batch before it had closed: (2, 59) and (3, 100)
    assert minutes == {minute(0): (2, 1, 0), minute(1): (2, 1, 0), minute(2): (1, 0, 0), minute(3): (1, 0, 0), minute(5): (1, 0, 0), minute(6): (0, 0, 1)}


def test_counters_stream_equals_batch(spark, tmp_path):
    df, out = _streamed(spark, tmp_path, lambda s: jobs.outcome_windows(s, ["status"]), "counted")
    done = out.agg(F.max("start")).first()[0]
    batch = df.groupBy(F.window("ts", "1 minute").start.alias("start"), "status").agg(F.count("*").alias("n")).where(F.col("start") <= F.lit(done))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_histogram_stream_equals_batch(spark, tmp_path):
    df, out = _streamed(spark, tmp_path, lambda s: jobs.latency_windows(s), "timed")
    for row in out.collect():
        own = df.where((F.col("ts") >= F.lit(row.start)) & (F.col("ts") < F.lit(row.start + dt.timedelta(minutes=1))))
        hist = {r.le: r.n for r in requests.latency_histogram(own).collect()}
        assert all(hist[str(b)] == row[f"le_{b}"] for b in requests.BOUNDS) and hist["+Inf"] == row.n


def _arrive(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "lease_id string, source string, page int, text string").coalesce(1).write.parquet(str(tmp_path / "pages" / name))
    jobs.streaming_ingest(spark, str(tmp_path / "pages" / "*"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    chunks = [(r.lease_id, r.page, r.chunk_no, r.text) for r in jobs.ingested(spark, str(tmp_path / "out")).orderBy("lease_id", "chunk_no").collect()]
    return chunks, sorted((r.lease_id, r.reason) for r in jobs.ingested(spark, str(tmp_path / "out"), "rejects").collect())


def test_streaming_ingest_over_batches(spark, tmp_path):
    chunks, rejects = _arrive(spark, tmp_path, "1", [("a", "s", 1, "1. One\n2. Two"), ("b", "t", 1, " ")])
    assert chunks == [("a", 1, 0, "1. One"), ("a", 1, 1, "2. Two")] and rejects == [("b", "no extractable text")]
    chunks, rejects = _arrive(spark, tmp_path, "2", [("a", "s", 2, "Three"), ("b", "t", 2, "text")])
    assert chunks == [("a", 1, 0, "1. One"), ("a", 1, 1, "2. Two"), ("a", 2, 2, "Three"), ("b", 2, 0, "text")] and rejects == []
    chunks, rejects = _arrive(spark, tmp_path, "3", [("b", "t", 2, "")])  # the lease has lost its text
    assert [c[0] for c in chunks] == ["a"] * 3 and rejects == [("b", "no extractable text")]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    pages = spark.createDataFrame([("a", "s", 1, "One"), ("b", "t", 1, " ")], "lease_id string, source string, page int, text string")
    for _ in range(2):
        jobs.ingest_batch(pages, str(tmp_path), 0)
    assert jobs.ingested(spark, str(tmp_path)).count() == 1 and jobs.ingested(spark, str(tmp_path), "rejects").count() == 1


def test_a_replay_after_a_compaction_changes_nothing(spark, tmp_path):
    """Batches fold those before them; a batch that is replayed finds the same state and leaves the same."""
    page = lambda *rows: spark.createDataFrame(rows, "lease_id string, source string, page int, text string")
    batches = [page(("a", "s", 1, "One"), ("b", "t", 1, "B one")), page(("a", "s", 2, "Two")), page(("c", "u", 1, "C one"), ("a", "s", 1, "First")), page(("b", "t", 2, "B two"), ("a", "s", 3, " "))]
    for n, rows in enumerate(batches):
        jobs.ingest_batch(rows, str(tmp_path), n, buckets=1, most=1)
    jobs.ingest_batch(batches[-1], str(tmp_path), 3, buckets=1, most=1)
    chunks = sorted((r.lease_id, r.chunk_no, r.text) for r in jobs.ingested(spark, str(tmp_path), buckets=1).collect())
    assert chunks == [("a", 0, "First"), ("a", 1, "Two"), ("b", 0, "B one"), ("b", 1, "B two"), ("c", 0, "C one")]
    assert jobs.ingest_store(spark, str(tmp_path), 1).folders() == {0: [2, 3]}


def test_a_batch_reads_its_leases_buckets_alone(spark, tmp_path):
    rows = [(f"lease{k}", "s", 1, f"text {k}") for k in range(40)]
    jobs.ingest_batch(spark.createDataFrame(rows, "lease_id string, source string, page int, text string"), str(tmp_path), 0, buckets=8)
    store = jobs.ingest_store(spark, str(tmp_path), 8)
    one = spark.createDataFrame([("lease7",)], "lease_id string")
    (bucket,) = store.touched(one)
    files = store.read("pages", [bucket], 1).inputFiles()
    assert len(store.folders("pages")) > 4 and files and all(f"/bucket={bucket}/" in f for f in files)


def test_a_compaction_that_died_is_finished(spark, tmp_path):
    page = lambda *rows: spark.createDataFrame(rows, "lease_id string, source string, page int, text string")
    for n in range(3):
        jobs.ingest_batch(page((f"l{n}", "s", 1, f"text {n}"), ("x", "s", n, f"page {n}")), str(tmp_path), n, buckets=1)
    before = sorted(map(tuple, jobs.ingested(spark, str(tmp_path), buckets=1).collect()))

    class Dies(jobs.LeaseStore):
        left = 2

        def _exchange(self, kind, bucket, batch):
            if not self.left:
                raise RuntimeError("lost")
            self.left -= 1
            super()._exchange(kind, bucket, batch)

    store = jobs.ingest_store(spark, str(tmp_path), 1)
    store.__class__ = Dies
    with pytest.raises(RuntimeError, match="lost"):
        store.compact(1)
    assert sorted(map(tuple, jobs.ingested(spark, str(tmp_path), buckets=1).collect())) == before
    assert jobs.ingest_store(spark, str(tmp_path), 1).folders() == {0: [2]}


def test_a_batch_chunks_only_what_came(spark, tmp_path, monkeypatch):
    """Known pages keep the chunks they have; of a page that came twice in a batch the greater text counts."""
    page = lambda *rows: spark.createDataFrame(rows, "lease_id string, source string, page int, text string")
    seen, chunk_pages = [], jobs.chunking.chunk_pages
    monkeypatch.setattr(jobs.chunking, "chunk_pages", lambda rows: (seen.append(sorted(r.page for r in rows.collect())), chunk_pages(rows))[1])
    jobs.ingest_batch(page(("a", "s", 1, "One"), ("a", "s", 2, "Two"), ("b", "s", 1, "B")), str(tmp_path), 0, buckets=1)
    jobs.ingest_batch(page(("a", "s", 2, "Second"), ("a", "s", 2, "First"), ("a", None, 3, "Three")), str(tmp_path), 1, buckets=1)
    jobs.ingest_batch(page(("a", None, 3, "Third")), str(tmp_path), 2, buckets=1)
    assert seen == [[1, 1, 2], [2, 3], [3]]
    chunks = sorted((r.lease_id, r.chunk_no, r.chunk_id, r.text) for r in jobs.ingested(spark, str(tmp_path), buckets=1).collect())
    assert chunks == [("a", 0, "a::0", "One"), ("a", 1, "a::1", "Second"), ("a", 2, "a::2", "Third"), ("b", 0, "b::0", "B")]
