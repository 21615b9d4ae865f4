"""Substring dedup over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  Each window is filed
under its anchor, the smallest hash among its sub-windows of ``ANCHOR`` words;
neighbouring windows mostly share an anchor, so a document has about one entry
for four or five windows, and equal windows always have equal anchors.  An entry
holds the anchor (32 bits), the document, the place of its first window and the
64-bit signatures of its windows, taken from a second hash family and kept side by
side in one binary value.

The index is a log of immutable runs.  Adding a batch writes its entries as one
more run, bucketed and sorted by anchor, and merge-joins it with every earlier
run bucket by bucket, so that no old entry is shuffled again.  Entries whose
anchor no other document has are done; the others are verified window by window:
anchor and signature must agree.  Before a batch is added, runs that have gathered
are compacted into one, again bucket by bucket, which keeps the smallest document
of each distinct entry.

A window is a duplicate if it also starts in a document with a smaller doc_id,
in its own batch or in an earlier one.  Batches come in ascending order of
doc_id, as runs are not judged again when a later batch is added.

Defined results: null or empty text has no words; a text under ``WINDOW`` words
keeps all; rows with a null doc_id stay whole and are not indexed; repeated rows
of one doc_id never remove one another's words (rows that share a doc_id must
share their text); other columns pass through untouched, but a column named like
one of the results is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import delete, drop, new_path, saved
from .words import WORD_PATTERN, Words, mix, rolled, slices

WINDOW = 13
ANCHOR = 5
#: More files than this in one run (writing tasks times buckets) are avoided by a shuffle before the run is written.
RUN_FILES = 20_000
#: Bytes of a signature.
SIGN = 8
_ENTRY = "anchor int, doc_id long, place int, signs binary"
_WORD = re.compile(WORD_PATTERN)


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of (doc_id, text) batches."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            n = len(words) - WINDOW + 1
            if n <= 0:
                continue
            sub = rolled(words.hashes(0), ANCHOR, 0)
            low, at = sub[:n].copy(), np.zeros(n, np.int64)
            for k in range(1, WINDOW - ANCHOR + 1):
                less = sub[k : n + k] < low
                low[less], at[less] = sub[k : n + k][less], k
            sign = rolled(words.hashes(1), WINDOW, 1).view(np.int64)
            here = np.arange(n)
            whole = here + WINDOW <= words.stop_word[:n]  # the window lies in one text
            anchor_at = at + here
            keep = np.flatnonzero(whole)
            if not len(keep):
                continue
            new = np.ones(len(keep), bool)
            new[1:] = (np.diff(anchor_at[keep]) != 0) | (np.diff(keep) != 1)
            first = np.flatnonzero(new)
            begin = keep[first]
            doc = words.doc[begin]
            ids = part.column("doc_id").take(pa.array(doc))
            bounds = (np.append(first, len(keep)) * SIGN).astype(np.int32)
            signs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(sign[keep]))])
            anchors = (mix(low[begin]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), ids, pa.array((begin - words.first[doc]).astype(np.int32)), signs], ["anchor", "doc_id", "place", "signs"])


def _windows(rows: DataFrame) -> DataFrame:
    """One row a window of an entry: its number ``k`` there and its ``sign``."""
    numbers = F.sequence(F.lit(0), (F.octet_length("signs") / SIGN).cast("int") - 1)
    return rows.withColumn("k", F.explode(numbers)).withColumn("sign", F.substring("signs", F.col("k") * SIGN + 1, F.lit(SIGN))).drop("signs")


class FingerprintIndex:
    """Runs of window fingerprints as bucketed tables in the folder that all executors share.

    ``buckets`` bounds the memory of a merge task: a bucket of one run is sorted
    within one task.  ``fan_in`` runs are compacted into one before the next is added.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = 2):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.name = f"fingerprints_{uuid.uuid4().hex[:12]}"
        self.folder = new_path(spark, "fingerprints")
        self.runs: list[str] = []
        self.made = 0

    def _bucketed(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name)
        return self.spark.table(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.folder}/{name}")

    def _flush(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        self.runs.append(f"{self.name}_{self.made}")
        return self._bucketed(rows, self.runs[-1])

    def add_batch(self, docs: DataFrame) -> DataFrame:
        """Index a batch, after a compaction if runs have gathered; its duplicate windows as a written (doc_id, place)."""
        if len(self.runs) >= self.fan_in:
            self.compact()
        rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(entries, _ENTRY)
        if docs.rdd.getNumPartitions() * self.buckets > RUN_FILES:
            rows = rows.repartition(self.buckets, "anchor")
        older = [self.spark.table(run) for run in self.runs]
        new = self._flush(rows)
        # buckets meet bucket by bucket up to here; only windows under shared anchors are shuffled below
        shared = new.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        again = F.col("low") < F.col("high")
        for k, run in enumerate(older):
            shared = shared.join(run.groupBy("anchor").agg(F.lit(True).alias(f"seen{k}")), "anchor", "left")
            again = again | F.col(f"seen{k}").isNotNull()
        shared = self._bucketed(shared.where(again).select("anchor"), f"{self.runs[-1]}_shared")  # read once for each run
        windows = _windows(new.join(shared, "anchor", "left_semi"))
        first = windows.groupBy("anchor", "sign").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        again, lows = F.col("low") < F.col("high"), [F.col("low")]
        for k, run in enumerate(older):
            old = _windows(run.join(shared, "anchor", "left_semi").select("anchor", "doc_id", "signs")).groupBy("anchor", "sign").agg(F.min("doc_id").alias(f"low{k}"))
            first = first.join(old, ["anchor", "sign"], "left")
            again = again | F.col(f"low{k}").isNotNull()
            lows.append(F.col(f"low{k}"))
        # written, so that the join below has plain shuffles on both sides, of which a hot window's can be split
        first = saved(first.where(again).select("anchor", "sign", (F.least(*lows) if older else lows[0]).alias("first")), "first-windows")
        found = windows.join(first, ["anchor", "sign"]).where(F.col("first") < F.col("doc_id"))
        found = saved(found.select("doc_id", (F.col("place") + F.col("k")).alias("place")), "duplicate-windows")
        drop(first)
        self._drop(f"{self.runs[-1]}_shared")
        return found

    def _merged(self) -> DataFrame:
        one = reduce(DataFrame.unionByName, map(self.spark.table, self.runs)).groupBy("anchor", "signs").agg(F.min("doc_id").alias("doc_id"))
        return one.select("anchor", "doc_id", F.lit(None).cast("int").alias("place"), "signs")

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket; of equal entries the smallest document stays, and places go, as only a new batch's count."""
        if len(self.runs) < 2:
            return
        old, rows = self.runs, self._merged()
        self.runs = []
        self._flush(rows)
        for run in old:
            self._drop(run)

    def close(self) -> None:
        for run in self.runs:
            self._drop(f"{run}_shared")
            self._drop(run)
        delete(self.spark, self.folder)
        self.runs = []


def batches_of(docs: DataFrame, count: int) -> list[DataFrame]:
    """All rows with a doc_id in ``count`` batches of ascending id ranges."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    step = (high - low) // count + 1
    return [docs.where((F.col("doc_id") >= low + k * step) & (F.col("doc_id") < low + (k + 1) * step)) for k in range(count)]


def duplicate_windows(docs: DataFrame, buckets: int | None = None, batches: int = 3) -> DataFrame:
    """(doc_id, places array<int>): where duplicate windows start, by way of an index."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        found = [index.add_batch(batch) for batch in batches_of(docs.select("doc_id", "text"), batches)]
    finally:
        index.close()
    rows = reduce(DataFrame.unionByName, found)
    places = saved(rows.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "duplicate-places")  # at most a document's words
    for table in found:
        drop(table)
    return places


def kept_words(text: str | None, places: list[int] | None) -> tuple[int, int, str]:
    """(words, words removed, kept words joined by a space) of one text."""
    words = _WORD.findall(text or "")
    if not places:
        return len(words), 0, " ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    at = np.asarray(places)
    np.add.at(gone, at, 1)
    np.add.at(gone, np.minimum(at + WINDOW, len(words)), -1)
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return len(words), len(words) - len(stay), " ".join([words[i] for i in stay])


def deduplicated(docs: DataFrame, buckets: int | None = None, batches: int = 3) -> DataFrame:
    """All columns of ``docs``, then n_words, n_removed and kept_text."""
    return _joined(docs, duplicate_windows(docs, buckets, batches), "kept_text", lambda kept: kept)


def _joined(docs: DataFrame, places: DataFrame, last: str, finish) -> DataFrame:
    own = ("n_words", "n_removed", last)
    kept = [f.name for f in docs.schema if f.name.lower() not in own]
    # the caller's columns travel as one, so that no name of theirs meets one of ours
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*(F.col(f"`{c}`").alias(c) for c in kept)).alias("row"))
    rows = rows.join(places.withColumnRenamed("doc_id", "at_id"), F.col("id") == F.col("at_id"), "left").select("row", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            out = [kept_words(t.as_py(), p.as_py()) for t, p in zip(row.field("text"), batch.column("places"), strict=True)]
            cols = [pa.array([w for w, _, _ in out], pa.int64()), pa.array([r for _, r, _ in out], pa.int64()), pa.array([finish(k) for _, _, k in out], pa.string())]
            yield pa.RecordBatch.from_arrays([row, *cols], ["row", *own])

    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])
    return rows.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in kept), *own)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and the digest of the kept words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = _joined(docs, duplicate_windows(docs), "kept_sha256", lambda kept: hashlib.sha256(kept.encode()).hexdigest())
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM dup) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(gone, p)], ' ') END AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM kept
"""

QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {"op2_substring_dedup": _SQL}
