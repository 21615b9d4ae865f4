"""Queries that write: reports, streaming ingest and the retention sweep; and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.redaction import PII_RULES, redact_pii
from clausemill.operators import evaluate, leases, retrieval
from clausemill.operators.requests import BOUNDS, rate_limit_stream
from clausemill.operators.retention import Retention
from clausemill.sources import tables, validate
from clausemill.sources.store import LeaseStore
from clausemill.streaming import jobs

from .bindings import pages, requests, table
from .chunk_queries import CHUNKED, masked
from .record_queries import LIMITED, NOW, REGRESSION, _metrics, _orders
from .retrieval_queries import RERANKED, _asked, _documents, stored_index


def a9_write_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "report")
    rows = evaluate.regression_check(*_metrics(spark, sf_dir))
    tables.write_eval_report(rows, path, NOW)
    return spark.read.schema("metric string, current double, prior double, pct double, status string, generated_at string").json(path)


def a3_gate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files of one to ten documents: some with the signature, some too large, some of another type, and read as what they are."""
    path = tables.new_path(spark, "uploads")
    docs = table(spark, sf_dir, "documents").withColumn("file", F.floor(F.col("doc_id") / 10))
    files = docs.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))  # ten at most
    value = F.concat(F.when(F.col("file") % 3 > 0, "%PDF-1.7 ").otherwise(""), "text")
    kind = F.when(F.col("file") % 5 > 0, "pdf").when(F.col("file") % 2 > 0, "txt").otherwise("odd")
    files.select(value.alias("value"), kind.alias("type"), "file").repartition("file").write.partitionBy("type", "file").text(path)
    found = validate.gate_uploads(tables.read_uploads(spark, path), 25_000)
    return found.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "length", "reason")


def a5_read_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "golden")
    items = table(spark, sf_dir, "benchmark")
    category = F.element_at(F.array(*map(F.lit, tables.CATEGORIES)), (F.col("item_id") % 4 + 1).cast("int"))
    line = F.to_json(F.struct(F.col("text").alias("question"), F.array(F.col("item_id").cast("string")).alias("relevant_clause_ids"), F.lit("a").alias("reference_answer"), category.alias("category"), (F.col("item_id") % 4 == 3).alias("should_refuse")))
    items.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    rows = tables.read_golden(spark, path)
    return rows.select(F.md5("question").alias("digest"), F.concat_ws(",", "relevant_clause_ids").alias("ids"), "reference_answer", "category", "should_refuse")


def a6_json_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a store, with lines that cannot be read among them."""
    path = tables.new_path(spark, "store")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    tables.write_json_store(rows, path)
    rows.where("id % 10 = 0").select(F.concat(F.lit('{"id": '), F.col("id"), F.lit(', "name')).alias("value")).write.mode("append").text(path)
    kept, corrupt = tables.read_json_store(spark, path, "id bigint, name string, balance double")
    return kept.crossJoin(corrupt)  # one row


def a7_upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks of their sources, then two sources again with their odd documents alone."""
    path = tables.new_path(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("lease_id"), "doc_id", "text")
    tables.upsert_chunks(docs, path)
    tables.upsert_chunks(docs.where("lease_id in ('src1', 'src2') and doc_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("lease_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("n_chars"))


def _arriving(spark: SparkSession, sf_dir: str, root: str, back: str = "12 hours", files: int = 4) -> DataFrame:
    """Events as they would come in: in files, each of a span of days, up to 12 hours out of order or, every fiftieth, ``back`` behind; with ``batch``."""
    rows = table(spark, sf_dir, "events").withColumn("jitter", F.expr(f"CASE WHEN event_id % 50 = 7 THEN INTERVAL {back} ELSE make_dt_interval(0, 0, 0, event_id % 720 * 60) END"))
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    width = max(1, int((span.b - span.a).total_seconds()) // files + 1)
    came = F.floor((F.unix_seconds((F.col("ts") + F.col("jitter")).cast("timestamp")) - F.unix_seconds(F.lit(span.a).cast("timestamp"))) / width)
    rows = saved_batches(rows.withColumn("batch", F.least(came, F.lit(files - 1)).cast("int")).drop("jitter"), root, files)
    return rows


def saved_batches(rows: DataFrame, root: str, files: int) -> DataFrame:
    """The rows of each ``batch`` as one file, written in turn, as a file source reads them by their times."""
    rows = tables.saved(rows, "events")
    for k in range(files):
        rows.where(F.col("batch") == k).repartition(1).write.mode("append").parquet(root)  # one file is one batch
    return rows


def _stream(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def h2_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate limiter as a stream over all events, in several batches and out of order within the watermark; a last row moves that past them."""
    root = tables.new_path(spark, "limited")
    came = _arriving(spark, sf_dir, f"{root}/in")
    end = came.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit(-1).cast(came.schema["user_id"].dataType).alias("user_id"))
    came.limit(0).unionByName(end, allowMissingColumns=True).repartition(1).write.mode("append").parquet(f"{root}/in")
    stream = _stream(spark, f"{root}/in", came.schema).select(F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("client_key"))
    return jobs.to_table(rate_limit_stream(stream, 3, 86_400, "1 day"), f"{root}/out", f"{root}/checkpoint")


def h4_count_outcomes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the days that the watermark has passed."""
    root = tables.new_path(spark, "outcomes")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumnRenamed("event_type", "status")
    rows = jobs.to_table(jobs.outcome_windows(stream, ["status"], "1 day"), f"{root}/out", f"{root}/checkpoint")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


def h4_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream in several batches counted by day and status, what came too late for it, and what is still open."""
    root = tables.new_path(spark, "late")
    came = _arriving(spark, sf_dir, f"{root}/in", "9 days")
    stream = _stream(spark, f"{root}/in", came.schema).withColumnRenamed("event_type", "status")
    counted = jobs.to_table(jobs.outcome_windows(stream, ["status"], "1 day", "1 day"), f"{root}/out", f"{root}/checkpoint")
    rows = jobs.late_rows(came.withColumnRenamed("event_type", "status"), counted, ["status"], "1 day", "1 day")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


def h5_latency_histogram_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tables.new_path(spark, "latency")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumnRenamed("value", "latency_ms")
    rows = jobs.to_table(jobs.latency_windows(stream, "1 day"), f"{root}/out", f"{root}/checkpoint")
    return rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total_ms": F.round("total_ms", 2)})


def h8_streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each lease after its pages came in by a stream, in batches of one file each; and the leases rejected."""
    root = tables.new_path(spark, "ingest")
    rows = pages(spark, sf_dir).withColumn("page", F.col("page").cast("int"))
    rows = rows.unionByName(rows.select(F.concat(F.lit("blank-"), "lease_id").alias("lease_id"), "source", "page", F.lit(" ").alias("text")).where("page % 7 = 0"))
    rows.repartition(3, "page").write.parquet(f"{root}/in")
    jobs.streaming_ingest(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", files=1, buckets=8, most=2).awaitTermination()
    chunks = jobs.ingested(spark, f"{root}/out", buckets=8).groupBy("lease_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_no").alias("last"), F.lit(None).cast("string").alias("reason"))
    rejects = jobs.ingested(spark, f"{root}/out", "rejects", 8).select("lease_id", F.lit(0).cast("long").alias("n_chunks"), F.lit(None).cast("long").alias("last"), "reason")
    return chunks.unionByName(rejects)


def h9_retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sweeps over stored tables on two ticks, the second run again: in the first a step fails for some leases, the second takes those.

    One row a sweep: what it took and removed, and what is left after all.
    """
    root = tables.new_path(spark, "retention")
    records = _orders(spark, sf_dir)
    lease = records.schema["lease_id"].dataType.simpleString()
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lease_id"), "l_linenumber")
    line = items.schema["l_linenumber"].dataType.simpleString()
    stored = {
        "chunks": (items, f"lease_id {lease}, l_linenumber {line}"),
        "answers": (items.where("l_linenumber = 1"), f"lease_id {lease}, l_linenumber {line}"),
        "records": (records, f"lease_id {lease}, created_at string"),
    }
    stores = {name: LeaseStore(spark, f"{root}/{name}", {name: schema}, 4, lease) for name, (_, schema) in stored.items()}
    for name, (rows, _) in stored.items():
        stores[name].write(0, rows.select("lease_id"), few=True, **{name: rows})
    retention = Retention(spark, f"{root}/journal", {name: stores[name] for name in ("chunks", "answers")}, stores["records"])
    down = records.where("lease_id % 7 = 0").select("lease_id", F.lit("answers").alias("step"), F.lit("store is down").alias("error"))
    for k in range(2):
        spark.range(0, 1, 1, 1).select(F.lit(NOW).cast("timestamp").alias("now")).write.mode("append").parquet(f"{root}/ticks")
        jobs.retention_sweeps(spark, f"{root}/ticks", f"{root}/checkpoint", retention, 1000, lambda n: down if n == 0 else None)
    retention.sweep(1, NOW, 1000)
    left = [stores[name].read(name).agg(F.count("*").alias(f"{name}_left")) for name in stored]
    found = spark.read.option("basePath", f"{root}/journal").parquet(*(f"{root}/journal/sweep={k}/report" for k in range(2)))
    rows = found.groupBy("sweep").agg(F.count("*").alias("eligible"), F.count_if("succeeded").alias("succeeded"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_answers").alias("n_answers"), F.max(F.get("errors", 0)).alias("error"))
    for one in left:
        rows = rows.crossJoin(one)  # one row
    return rows


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited evidence for every question: BM25, trigram rerank, refusal gate and redacted excerpts."""
    asked, docs = _asked(spark, sf_dir), _documents(spark, sf_dir)
    hits = tables.saved(retrieval.retrieve(asked, docs, "lexical+rerank", lexical=retrieval.bm25_topk(asked, stored_index(spark, sf_dir))), "hits")
    gate = retrieval.refusal_gate(asked, hits)
    cited = docs.join(retrieval.bounded(hits), "chunk_id").withColumn("excerpt", redact_pii(F.substring("text", 1, 500), ascii=True))
    return gate.join(cited, "query_id", "left").select("query_id", "refused", F.round("confidence", 5).alias("confidence"), "rank", "chunk_id", F.round("distance", 5).alias("distance"), "excerpt")


QUERIES = {f.__name__: f for f in (a3_gate_uploads, a5_read_golden, a6_json_store, a7_upsert_chunks, a9_write_eval_report, h2_rate_limit_stream, h4_count_outcomes_stream, h4_late_rows, h5_latency_histogram_stream, h8_streaming_ingest, h9_retention_sweep)} | {"ask": flagship}
_DAYS = "days AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS status, value FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND)"
#: Events with the batch in which ``_arriving`` puts them, a few days late.
_CAME = """span AS (SELECT min(ts) AS a, greatest(1, floor(epoch(max(ts) - min(ts)))::BIGINT // 4 + 1) AS width FROM events),
came AS (SELECT ts, event_type AS status, least(floor((floor(epoch(ts + CASE WHEN event_id % 50 = 7 THEN INTERVAL 9 DAY ELSE to_seconds(event_id % 720 * 60) END))::BIGINT - floor(epoch(a))::BIGINT) / width), 3)::INT AS batch FROM events, span)"""
ORACLES = {
    "a3_gate_uploads": """SELECT file, length, CASE WHEN file % 5 = 0 THEN 'type' WHEN length > 25000 THEN 'size' WHEN file % 3 = 0 THEN 'signature' END AS reason
FROM (SELECT doc_id // 10 AS file, 1 + CASE WHEN doc_id // 10 % 3 > 0 THEN 9 ELSE 0 END + strlen(string_agg(text, chr(10) ORDER BY doc_id)) AS length FROM documents GROUP BY doc_id // 10, doc_id // 10 % 3)""",
    "a5_read_golden": "SELECT md5(text) AS digest, item_id::VARCHAR AS ids, 'a' AS reference_answer, ['factual', 'statute', 'red_flag', 'out_of_scope'][item_id % 4 + 1] AS category, item_id % 4 = 3 AS should_refuse FROM benchmark",
    "a6_json_store": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS corrupt FROM customer",
    "a7_upsert_chunks": "SELECT source AS lease_id, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS n_chars FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 2 = 1 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 1) GROUP BY 1",
    "a9_write_eval_report": f"SELECT *, '{NOW}' AS generated_at FROM ({REGRESSION})",
    "ask": f"WITH {RERANKED} SELECT g.query_id, refused, confidence, rank, chunk_id, round(distance, 5) AS distance, {masked('substring(text, 1, 500)', PII_RULES)} AS excerpt FROM gate g LEFT JOIN reranked r ON r.query_id = g.query_id LEFT JOIN documents d ON d.doc_id = r.chunk_id",
    "h2_rate_limit_stream": LIMITED,
    "h4_count_outcomes_stream": f"WITH {_DAYS} SELECT start, status, count(*) AS n FROM days GROUP BY ALL",
    # a batch drops what the watermark of the batch before it had closed, which is the latest time of the batches before that
    "h4_late_rows": f"""WITH {_CAME}, top AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark FROM came GROUP BY batch),
e AS (SELECT status, date_trunc('day', ts)::TIMESTAMP AS start, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= date_trunc('milliseconds', mark), false) AS late, date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM came) - INTERVAL 1 DAY AS closed FROM came JOIN top USING (batch))
SELECT start, status, count(*) FILTER (closed AND NOT late) AS counted, count(*) FILTER (closed AND late) AS dropped, count(*) FILTER (NOT closed) AS pending FROM e GROUP BY ALL""",
    "h5_latency_histogram_stream": f"WITH {_DAYS} SELECT start, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in BOUNDS) + ", count(*) AS n, round(sum(value), 2) AS total_ms FROM days GROUP BY 1",
    "h8_streaming_ingest": f"""{CHUNKED}
SELECT lease_id, count(*) AS n_chunks, count(*) - 1 AS last, NULL::VARCHAR AS reason FROM chunks JOIN named USING (id) GROUP BY 1
UNION ALL SELECT DISTINCT 'blank-' || source, 0, NULL::BIGINT, 'no extractable text' FROM documents WHERE (doc_id + 1) % 7 = 0""",
    "h9_retention_sweep": """WITH e AS (SELECT o_orderkey, o_orderkey % 7 = 0 AS down FROM orders WHERE epoch(TIMESTAMP '2001-08-02' - o_orderdate) / 86400 >= 1000),
l AS (SELECT l_orderkey, l_linenumber, down FROM lineitem LEFT JOIN e ON l_orderkey = o_orderkey),
kept AS (SELECT (SELECT count(*) FROM l WHERE down IS NULL) AS chunks_left, (SELECT count(*) FROM l WHERE down IS NULL AND l_linenumber = 1) AS answers_left, (SELECT count(*) FROM orders) - (SELECT count(*) FROM e) AS records_left)
SELECT 0 AS sweep, count(*) AS eligible, count(*) FILTER (NOT down) AS succeeded, (SELECT count(*) FROM l WHERE down IS NOT NULL) AS n_chunks, (SELECT count(*) FROM l WHERE NOT down AND l_linenumber = 1) AS n_answers,
  max(CASE WHEN down THEN 'answers: store is down' END) AS error, any_value(chunks_left) AS chunks_left, any_value(answers_left) AS answers_left, any_value(records_left) AS records_left FROM e, kept
UNION ALL SELECT 1, count(*) FILTER (down), count(*) FILTER (down), 0, (SELECT count(*) FROM l WHERE down AND l_linenumber = 1), NULL, any_value(chunks_left), any_value(answers_left), any_value(records_left) FROM e, kept""",
}
