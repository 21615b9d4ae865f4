"""Request logs: client keys, rate limits, counters and latency histograms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from clausemill.functions.text import hash_query

LIMIT, SECONDS = 30, 60
#: Size of a quantile sketch; its ranks are off by under RANK_ERROR (99 % of the time).
SKETCH, RANK_ERROR = 400, 0.0075
BOUNDS = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def client_key(forwarded: str = "forwarded_for", host: str = "host", request: str = "request_id") -> Column:
    """First forwarded hop, else the host, else a key of the request's own."""
    hop = F.nullif(F.trim(F.get(F.split(forwarded, ","), 0)), F.lit(""))
    return F.coalesce(hop, F.nullif(F.trim(host), F.lit("")), F.concat(F.lit("unknown-"), F.col(request).cast("string")))


def over_limit_windows(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """Adds ``in_window``, the client's requests of the trailing window, and ``over``."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("client_key").orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    rows = requests.withColumn("_us", micros).withColumn("in_window", F.count("*").over(w))
    return rows.withColumn("over", F.col("in_window") > limit).drop("_us")


def limited(times: list[int], limit: int, seconds: int, accepted: list[int] | None = None) -> tuple[list[bool], list[int | None], list[int]]:
    """Sliding log over ordered microseconds: (allowed, retry_after, accepted times still in the window)."""
    log, span = list(accepted or []), seconds * 1_000_000
    allowed, retry = [], []
    for now in times:
        log = [t for t in log if t > now - span]
        if len(log) >= limit:
            allowed.append(False)
            retry.append(max(1, int(seconds - (now - log[0]) / 1_000_000) + 1))
        else:
            log.append(now)
            allowed.append(True)
            retry.append(None)
    return allowed, retry, log


def rate_limit(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """(request_id, client_key, allowed, retry_after) of every request.

    Refused requests do not count, so a client's requests are read in order.  A
    client that never exceeds the plain window count is allowed as a whole and
    never leaves the JVM; only the others are sorted for the sequential pass, which
    streams over them and holds no client's requests at once.
    """
    screened = over_limit_windows(requests, limit, seconds)
    hot = screened.groupBy("client_key").agg(F.max("over").alias("hot")).where("hot").select("client_key")
    calm = requests.join(hot, "client_key", "left_anti").select("request_id", "client_key", F.lit(True).alias("allowed"), F.lit(None).cast("long").alias("retry_after"))

    busy = requests.join(hot, "client_key", "left_semi").select("request_id", "client_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    busy = busy.repartition("client_key").sortWithinPartitions("client_key", "us", "request_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, log = None, []  # of the client being read: at most ``limit`` times are kept from batch to batch
        for batch in batches:
            clients, times = batch.column("client_key").to_pylist(), batch.column("us").to_pylist()
            allowed, retry, a = [], [], 0
            for b in range(1, len(clients) + 1):
                if b == len(clients) or clients[b] != clients[a]:
                    ok, wait, log = limited(times[a:b], limit, seconds, log if clients[a] == key else None)
                    allowed += ok
                    retry += wait
                    key, a = clients[a], b
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), batch.column("client_key"), pa.array(allowed, pa.bool_()), pa.array(retry, pa.int64())], ["request_id", "client_key", "allowed", "retry_after"])

    return calm.unionByName(busy.mapInArrow(run, "request_id long, client_key string, allowed boolean, retry_after long"))


def count_outcomes(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def latency_histogram(requests: DataFrame, *labels: str, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(labels, le, n, total_ms): cumulative counts by upper bound; one pass, then one row a bound."""
    sums = [F.count_if(F.col("latency_ms") <= b).alias(f"b{b}") for b in bounds]
    one = requests.groupBy(*labels).agg(*sums, F.count("latency_ms").alias("all"), F.sum("latency_ms").alias("total_ms"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in bounds), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return one.select(*labels, "total_ms", F.inline(rows))


def latency_quantile(histogram: DataFrame, *labels: str, q: float = 0.95) -> DataFrame:
    """Linear interpolation in the bucket that holds the quantile; the last finite bound beyond it."""
    rows = histogram.withColumn("bound", F.when(F.col("le") != "+Inf", F.col("le").cast("double")))
    w = Window.partitionBy(*labels) if labels else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("bound").asc_nulls_last())
    rows = rows.withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0))).withColumn("low", F.coalesce(F.lag("bound").over(order), F.lit(0.0))).withColumn("want", q * F.max("n").over(w))
    rows = rows.withColumn("last", F.max("bound").over(w))
    hit = rows.where((F.col("n") >= F.col("want")) & (F.col("before") < F.col("want")))
    value = F.when(F.col("bound").isNull(), F.col("last")).otherwise(F.col("low") + (F.col("bound") - F.col("low")) * (F.col("want") - F.col("before")) / (F.col("n") - F.col("before")))
    return hit.select(*labels, value.alias("quantile_ms"))


def latency_sketches(requests: DataFrame, *labels: str, width: str = "1 day", k: int = SKETCH) -> DataFrame:
    """(start, labels, n, sketch): a quantile sketch of the latencies of each window, a few KB whatever the window holds."""
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).where("latency_ms is not null")
    rows = rows.groupBy(F.window("ts", width).alias("w"), *labels).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("sketch"))
    return rows.select(F.col("w.start").alias("start"), *labels, "n", "sketch")


def merged_quantile(sketches: DataFrame, *labels: str, q: float = 0.95) -> DataFrame:
    """(labels, n, quantile_ms) of stored windows together: their sketches merge, the requests are not read again."""
    merged = sketches.groupBy(*labels).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*labels, "n", F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("quantile_ms"))


def access_log(requests: DataFrame, salt: str) -> DataFrame:
    """Log rows: the hash of a question instead of its text."""
    return requests.withColumn("query_hash", hash_query("question", salt)).drop("question")


def access_rollup(requests: DataFrame) -> DataFrame:
    """Requests and mean latency by route and status."""
    return requests.groupBy("route", "status").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms"))


class Limiter(StatefulProcessor):
    """Per client: requests the watermark has not passed, and the accepted times of the window.

    A request is decided when the watermark has passed it, so requests that come out
    of order within the watermark are decided in order.  A timer at the earliest one
    waiting decides all that have been passed by then; another, a window after the
    last accepted one, clears the client's state.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Requests that wait, and accepted times, which have no id: one list, so that a timer reads and writes the state once.
        self.log = handle.getListState("log", "us long, request_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, r.request_id) for r in rows]
        if new:
            self.log.appendList(new)
            self.handle.registerTimer(min(us for us, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, times = [], []
        for us, i in self.log.get():
            if i is None:
                times.append(us)
            else:
                waiting.append((us, i))
        waiting.sort()
        due = [w for w in waiting if w[0] < passed]
        if waiting and not due:  # an earlier timer of this batch decided all that is due, and set the next one
            return iter(())
        allowed, retry, times = limited([us for us, _ in due], self.limit, self.seconds, times)
        times = [t for t in times if t > passed - self.seconds * 1_000_000]
        left = waiting[len(due) :]
        if left or times:
            self.log.put([(t, None) for t in times] + left)
            self.handle.registerTimer(left[0][0] // 1000 + 1 if left else times[-1] // 1000 + self.seconds * 1000 + 1)
        else:
            self.log.clear()
        return (Row(request_id=i, client_key=key[0], allowed=ok, retry_after=wait) for (_, i), ok, wait in zip(due, allowed, retry, strict=True))

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS, late: str = "10 seconds") -> DataFrame:
    """``rate_limit`` on a stream of any number of batches: a request's row appears once the watermark has passed it.

    Requests up to ``late`` behind the latest are decided in order; later ones are
    dropped.  Needs the RocksDB state store, which is set for the session.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("client_key", "ts", F.unix_micros("ts").alias("us"), F.col("request_id").cast("long").alias("request_id"))
    return rows.groupBy("client_key").transformWithState(Limiter(limit, seconds), "request_id long, client_key string, allowed boolean, retry_after long", "Append", "EventTime")
