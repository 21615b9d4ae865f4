"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import chunking
from clausemill.operators.requests import BOUNDS
from clausemill.operators.retention import Retention
from clausemill.sources import tables, validate
from clausemill.sources.store import LeaseStore


def outcome_windows(events: DataFrame, labels: Sequence[str], width: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Counts by tumbling window and labels; later rows are dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *labels, "n")


def latency_windows(requests: DataFrame, width: str = "1 minute", late: str = "10 seconds", bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """Cumulative bucket counts, count and sum by tumbling window."""
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = [F.count_if(F.col("latency_ms") <= b).alias(f"le_{b}") for b in bounds]
    return rows.groupBy(F.window("ts", width).alias("w")).agg(*sums, F.count("latency_ms").alias("n"), F.sum("latency_ms").alias("total_ms")).select(F.col("w.start").alias("start"), *(f"le_{b}" for b in bounds), "n", "total_ms")


#: Chunks as they are stored; what numbers them depends on the lease's other pages.
PIECES = tables.CHUNKS.partition(", chunk_no")[0]
#: Stores of up to so many buckets are written by the tasks that read or chunk the pages.
FEW_BUCKETS = 8
#: Keys of a batch's pages up to this many (some 100 MB) are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def ingest_store(spark: SparkSession, root: str, buckets: int = 32) -> LeaseStore:
    """Pages, chunks (not numbered yet) and rejects of the leases ingested under ``root``."""
    return LeaseStore(spark, root, {"pages": tables.PAGES, "chunks": PIECES, "rejects": "lease_id string, reason string"}, buckets)


def ingest_batch(pages: DataFrame, root: str, batch_id: int, buckets: int = 32, most: int = 8) -> None:
    """One micro-batch of pages, which come in any order and over several batches.

    Of a page that came more than once the last text counts, in one batch the
    greatest.  Only pages that came are chunked; the others of the leases it touches
    are carried over with their chunks, read from those leases' buckets alone and
    matched by their keys, so no known text is chunked or shuffled again.  Chunks get
    their numbers when they are read (``ingested``).  Buckets with over ``most``
    batches are folded first, which keeps listings short too.
    """
    spark, key = pages.sparkSession, ["lease_id", "source", "page"]
    store = ingest_store(spark, root, buckets)
    store.compact(most, batch_id)
    new = pages.select(*key, "text")
    keys = tables.saved(new.groupBy(*key).agg(F.count("*").alias("n")), "keys")
    several = keys.where("n > 1").limit(1).count() > 0
    whole = None
    if several or pages.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # also deals out the texts of few files
        whole = new = tables.saved(new.groupBy(*key).agg(F.max("text").alias("text")), "arrived")
    came = F.broadcast(keys.drop("n")) if keys.count() <= BROADCAST_KEYS else keys.drop("n")
    touched = tables.saved(keys.select("lease_id").distinct(), "touched")
    own = store.touched(touched)

    def with_known(kind: str, rows: DataFrame) -> DataFrame:
        """The rows of the pages that came and, of their leases' other pages, those of the batch before."""
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
        known = store.read(kind, own, batch_id).join(touched, "lease_id", "left_semi").alias("r").join(came.alias("k"), same, "left_anti")
        return known.unionByName(rows)

    pieces = chunking.chunk_pages(new).withColumn("clause_type", chunking.classify("text"))
    few = buckets <= FEW_BUCKETS
    store.put(batch_id, "pages", with_known("pages", new), ["lease_id", "page"], few=few)
    store.put(batch_id, "chunks", with_known("chunks", pieces), ["lease_id", "page", "clause_no", "part_no"], few=few)
    store.put(batch_id, "rejects", validate.split_textless(store.read("pages", batch=batch_id))[1])
    store.put(batch_id, "leases", touched)
    for table in (keys, touched, *([whole] if whole is not None else [])):
        tables.drop(table)


def ingested(spark: SparkSession, root: str, kind: str = "chunks", buckets: int = 32) -> DataFrame:
    """The ``pages``, ``chunks`` or ``rejects`` in force: those of the last batch that touched their lease; chunks with their numbers."""
    rows = ingest_store(spark, root, buckets).read(kind)
    return chunking.assign_chunk_ids(rows).select(*(c.split()[0] for c in tables.CHUNKS.split(", "))) if kind == "chunks" else rows


def streaming_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, files: int | None = None, buckets: int = 32, most: int = 8):
    """Run over what has arrived under ``source`` (parquet pages), at most ``files`` a batch, then stop."""
    reader = spark.readStream.schema(tables.PAGES)
    pages = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    return pages.writeStream.foreachBatch(lambda df, n: ingest_batch(df, root, n, buckets, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(events: DataFrame, counted: DataFrame, labels: Sequence[str] = (), width: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """(start, labels, counted, dropped, pending): what a stream's windows (``outcome_windows``) have of all events.

    The batch form counts all of them.  What the stream lacks of a window that its
    watermark has closed came too late and was dropped; the other windows are still
    open and not written yet.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    end = rows.agg((F.date_trunc("millisecond", F.max("ts")) - F.expr(f"INTERVAL {late}")).alias("mark"))
    all_rows = rows.groupBy(F.window("ts", width).alias("w"), *labels).agg(F.count("*").alias("all"))
    both = all_rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *labels, "all").join(counted, ["start", *labels], "left").crossJoin(F.broadcast(end))  # one row
    lacks = F.col("all") - F.coalesce("n", F.lit(0))
    closed = F.col("end") <= F.col("mark")
    return both.select("start", *labels, F.coalesce("n", F.lit(0)).alias("counted"), F.when(closed, lacks).otherwise(0).alias("dropped"), F.when(closed, 0).otherwise(lacks).alias("pending"))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there, append its rows to a table, and read that; ``maxFilesPerTrigger`` of its source makes the batches."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def retention_sweeps(spark: SparkSession, ticks: str, checkpoint: str, retention: Retention, days: int, failures=None) -> None:
    """A sweep for each file of times (``now`` timestamps, the latest counts) that has arrived under ``ticks``, then stop.

    The number of the batch is that of the sweep, so a batch that is replayed goes on
    with its sweep.  ``failures(sweep_id)`` may give steps that fail.
    """

    def sweep(times: DataFrame, sweep_id: int) -> None:
        now = times.agg(F.max("now")).first()[0]
        if now is not None:
            retention.sweep(sweep_id, now.strftime("%Y-%m-%d %H:%M:%S"), days, failures(sweep_id) if failures else None, "sweep").write.mode("overwrite").parquet(f"{retention.root}/sweep={sweep_id}/report")

    stream = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(ticks)
    stream.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
