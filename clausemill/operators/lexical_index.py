"""A BM25 index kept on disk by lease, and the search in it by blocks of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.text import TOKEN
from clausemill.sources.store import BROADCAST_LEASES, LeaseStore
from clausemill.sources.tables import saved

K1, B, EPSILON = 1.5, 0.75, 0.25
#: The bytes of which each is a character of a token by itself, and those of the section sign, which is one too.
OWN, SIGN = np.array([re.fullmatch(TOKEN, chr(b)) is not None for b in range(128)] + [False] * 128), "§".encode()
#: Chunks of a lease for each part in which its rows are written.
PART = 1000
#: Buckets up to so many are written by the tasks that count their texts; rows of more are brought together first.
FEW_BUCKETS = 8
#: Texts that are counted, questions that are asked and entries of a block of chunks by terms that are multiplied at a time.
TEXTS, QUESTIONS, ENTRIES = 500, 256, 1 << 21


@dataclass(frozen=True)
class Bm25:
    """Okapi index: ``rows`` (lease_id, chunk_id, dl, terms), one a chunk with its (term, tf), and ``idf`` (lease_id, term, avgdl, idf)."""

    rows: DataFrame
    idf: DataFrame

    @property
    def tf(self) -> DataFrame:
        """(lease_id, chunk_id, dl, term, tf)."""
        return self.rows.select("lease_id", "chunk_id", "dl", F.inline("terms")).withColumn("tf", F.col("tf").cast("long"))

    @property
    def chunks(self) -> DataFrame:
        return self.rows.select("lease_id", "chunk_id")

    def postings(self) -> DataFrame:
        """(lease_id, term, chunk_id, weight), the whole contribution of a term to a chunk's score.

        Terms are far fewer than postings, so of a partition they are hashed and the
        postings are not sorted.
        """
        return self.tf.join(self.idf.hint("shuffle_hash"), ["lease_id", "term"]).select("lease_id", "term", "chunk_id", bm25_weight().alias("weight"))


def bm25_weight() -> Column:
    """Of rows with tf, dl, idf and avgdl."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of lower-cased texts: the row of each token, the terms that differ in order, and which of them each token is."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    # bytes of no token become spaces; the two of a section sign stand together in UTF-8 for nothing else
    token = OWN[data]
    sign = np.flatnonzero((data[:-1] == SIGN[0]) & (data[1:] == SIGN[1]))
    token[sign] = token[sign + 1] = True
    spaced = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(np.where(token, data, np.uint8(32))))
    lists = pc.ascii_split_whitespace(spaced)
    found = pc.list_flatten(lists).dictionary_encode()
    order = np.asarray(pc.sort_indices(found.dictionary))
    kind = np.int32 if len(texts) * len(order) < 1 << 31 else np.int64
    row = np.repeat(np.arange(len(texts), dtype=kind), np.asarray(pc.list_value_length(lists)))
    rank = np.empty(len(order), kind)
    rank[order] = np.arange(len(order), dtype=kind)
    terms, at = found.dictionary.take(pa.array(order)).cast(pa.string()), rank[np.asarray(found.indices)]
    if len(terms) and terms[0].as_py() == "":  # what is before a first space or after a last one
        row, terms, at = row[at > 0], terms.slice(1), at[at > 0] - kind(1)
    return row, terms, at


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """(lease_id, chunk_id, dl, terms) of each row: the number of its tokens and the (term, tf) of those that differ."""
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("lease_id", "chunk_id")}
    entry = pa.struct([("term", pa.string()), ("tf", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                row, terms, at = tokens_of(some.column("text"))
                # one number for each pair of row and term; equal ones are counted
                pair, tf = np.unique(row * row.dtype.type(len(terms)) + at, return_counts=True)
                row_of, term = np.divmod(pair, max(1, len(terms)))
                ends = pa.array(np.searchsorted(row_of, np.arange(len(some) + 1)), pa.int32())
                flat = [terms.take(pa.array(term)), pa.array(tf, pa.int32())]
                entries = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, fields=list(entry)))
                yield pa.RecordBatch.from_arrays([some.column("lease_id"), some.column("chunk_id"), pa.array(np.bincount(row, minlength=len(some)), pa.int32()), entries], ["lease_id", "chunk_id", "dl", "terms"])

    rows = chunks.select("lease_id", "chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInArrow(count, f"lease_id {kind['lease_id']}, chunk_id {kind['chunk_id']}, dl int, terms array<struct<term:string,tf:int>>")


def counted(chunks: DataFrame) -> DataFrame:
    """(lease_id, term, chunk_id, dl, tf) of each row, counted inside it.  A chunk without a token keeps a row."""
    rows = chunk_rows(chunks).select("lease_id", "chunk_id", "dl", F.inline_outer("terms"))
    return rows.select("lease_id", "term", "chunk_id", "dl", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))


def best_in_blocks(index: Bm25, asked: pa.Table, k: int, query: str) -> DataFrame:
    """(query_id, chunk_id, score): of each block of chunks the first ``k`` of every question with a score over 0; of equal scores the smaller ids.

    ``asked`` (lease_id, term, query_id, times, idf, avgdl) is small and goes to
    every task.  A block of chunks by terms is multiplied with the terms by questions
    of its lease, so pairs of question and chunk are no rows and none is shuffled but
    a block's best.
    """
    chunk = index.rows.schema["chunk_id"].dataType.simpleString()
    of_lease: dict = {}
    for i, lease in enumerate(asked.column("lease_id").to_pylist()):
        of_lease.setdefault(lease, []).append(i)

    def sides(own: pa.Table) -> tuple:
        """(terms, question ids, mean length, rows, columns and values of the matrix) of a lease."""
        terms, questions = (own.column(c).combine_chunks().dictionary_encode() for c in ("term", "query_id"))
        values = np.asarray(own.column("idf")) * np.asarray(own.column("times"))
        return terms.dictionary, questions.dictionary, own.column("avgdl")[0].as_py(), np.asarray(terms.indices), np.asarray(questions.indices), values

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            leases: dict = {}
            for i, lease in enumerate(batch.column("lease_id").to_pylist()):
                if lease in of_lease:
                    leases.setdefault(lease, []).append(i)
            for lease, at in leases.items():
                if lease not in known:
                    known = {lease: sides(asked.take(of_lease[lease]))}  # rows are stored by lease
                yield from scored(batch.take(pa.array(at)), *known[lease])

    def scored(rows: pa.RecordBatch, terms: pa.Array, questions: pa.Array, avgdl: float, t: np.ndarray, q: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows.column("chunk_id")))
        entries = rows.column("terms").flatten()
        row = np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(rows.column("terms"))))
        at = pc.index_in(entries.field("term"), value_set=terms)
        hit = np.asarray(pc.is_valid(at))
        row, at, tf = row[hit], np.asarray(at.drop_null()), np.asarray(entries.field("tf"))[hit]
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.asarray(rows.column("dl"))[row] / avgdl))
        step = max(1, ENTRIES // len(terms))
        for first in range(0, len(questions), QUESTIONS):
            some = (q >= first) & (q < first + QUESTIONS)
            right = np.zeros((len(terms), min(QUESTIONS, len(questions) - first)))
            right[t[some], q[some] - first] = values[some]
            for start in range(0, len(rows), step):
                a, b = np.searchsorted(row, (start, start + step))
                left = np.zeros((min(step, len(rows) - start), len(terms)))
                left[row[a:b] - start, at[a:b]] = weight[a:b]
                score = left @ right
                near = np.round(score, 9)
                least = np.partition(near, max(0, len(near) - k), axis=0)[max(0, len(near) - k)]
                r, c = np.nonzero((near >= least) & (near > 0))
                order = np.lexsort((r, -near[r, c], c))
                r, c = r[order], c[order]
                best = np.arange(len(r)) - np.searchsorted(c, c) < k
                r, c = r[best], c[best]
                yield pa.RecordBatch.from_arrays([questions.take(pa.array(c + first)), rows.column("chunk_id").take(pa.array(r + start)), pa.array(score[r, c])], ["query_id", "chunk_id", "score"])

    return index.rows.mapInArrow(search, f"query_id {query}, chunk_id {chunk}, score double")


class LexicalIndex:
    """Chunks with their terms, document frequencies and lease statistics of every lease, in a ``LeaseStore``.

    All figures of a lease depend on its own chunks alone.  So a batch brings leases
    with all their chunks and replaces what the index had of them; nothing of any
    other lease is read or written.  Texts are tokenised once and counted in their
    rows; a chunk stays one row with its terms, which is shuffled once, to its part,
    and all else is derived from those rows.
    """

    #: Number of the layout on disk.
    LAYOUT = 2

    def __init__(self, spark: SparkSession, root: str, lease: str = "string", chunk: str = "string", buckets: int = 32):
        kinds = {
            "chunks": f"lease_id {lease}, chunk_id {chunk}, dl int, terms array<struct<term:string,tf:int>>",
            "terms": f"lease_id {lease}, term string, df long",
            "stats": f"lease_id {lease}, n long, avgdl double, mean double",
        }
        self.store = LeaseStore(spark, root, kinds, buckets, lease)

    def update(self, chunks: DataFrame, batch_id: int) -> None:
        """Index the leases of ``chunks`` (lease_id, chunk_id, text) anew."""
        put, own = self.store.put, lambda kind: self.store.read(kind, batch=batch_id)
        ids = chunks.groupBy("lease_id", "chunk_id").agg(F.count("*").alias("rows"))
        sizes = saved(ids.groupBy("lease_id").agg(F.ceil(F.sum("rows") / PART).cast("int").alias("parts"), F.max("rows").alias("rows")), "sizes")  # one row a lease
        seen = sizes.agg(F.count("*").alias("leases"), F.max("rows").alias("rows")).first()
        small = F.broadcast if seen.leases <= BROADCAST_LEASES else lambda rows: rows
        part = F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
        rows = chunk_rows(chunks)
        if (seen.rows or 0) > 1:  # rows that share an id are one chunk
            each = rows.select("lease_id", "chunk_id", "dl", F.inline_outer("terms")).groupBy("lease_id", "chunk_id", "term").agg(F.max("dl").alias("dl"), F.sum("tf").cast("int").alias("tf"))
            rows = each.groupBy("lease_id", "chunk_id").agg(F.max("dl").alias("dl"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("terms"))
        few = min(seen.leases, self.store.buckets) <= FEW_BUCKETS
        put(batch_id, "chunks", rows.join(small(sizes.select("lease_id", "parts")), "lease_id"), ["lease_id", "chunk_id"], part, few)
        terms = own("chunks").select("lease_id", F.explode("terms.term").alias("term"))
        put(batch_id, "terms", terms.groupBy("lease_id", "term").agg(F.count("*").alias("df")), ["lease_id", "term"], few=few)
        lease = own("chunks").groupBy("lease_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        mean = own("terms").join(small(lease), "lease_id").groupBy("lease_id").agg(F.avg(_raw()).alias("mean"))
        put(batch_id, "stats", lease.join(mean, "lease_id", "left"))
        put(batch_id, "leases", own("stats").select("lease_id"))

    def remove(self, leases: DataFrame, batch_id: int) -> None:
        self.store.remove(leases, batch_id)

    def compact(self, most: int = 8) -> list[int]:
        return self.store.compact(most)

    def read(self, leases: DataFrame | None = None) -> Bm25:
        """The index of some leases, of which only the buckets are read, or of all.  A negative idf becomes EPSILON times the lease's mean idf."""
        buckets = None if leases is None else self.store.touched(leases)
        rows, terms, stats = (self.store.read(kind, buckets) for kind in ("chunks", "terms", "stats"))
        idf = terms.join(stats, "lease_id").withColumn("raw", _raw())
        idf = idf.select("lease_id", "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        return Bm25(rows, idf)


def _raw():
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
