"""Fill-in-middle transformation of documents, cut between lines.

A unit is a line with its line feed.  The text is laid over fixed blocks of
``BLOCK`` bytes; a Fenwick tree over the blocks holds the units that end in each and
the code points that begin in each.  To find where the first ``u`` units end, a
binary-lifting descent walks down the tree to the block of the u-th line feed and
sums the code points before it; the line feed is then looked up in that block alone.
So no list of lines is ever made, and a text costs one vectorised pass.

Which cuts and which form a document gets follows from a seeded hash of its id, not
from its place in the table: the rows do not depend on partitions or retries.

Defined results: a null text is an empty text; an empty text, and a text that holds
one of the marks already, stays plain; a null doc_id is hashed as an empty id;
repeated rows pass through one for one; other columns pass through untouched, but a
column named like one of the results is replaced by it; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text in one leaf of the tree.
BLOCK = 4096
SEED = 7
#: Of a hundred documents, how many are transformed, and how many of those get the suffix first.
RATE, SPM_RATE = 100, 50
_NEW_LINE = 0x0A


class BlockTree:
    """Units and code points of a UTF-8 text, as a Fenwick tree over its blocks."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        starts = np.arange(0, len(self.data), block)
        self.leaves = len(starts)
        self.tree = np.zeros((self.leaves + 1, 2), np.int64)
        if self.leaves:
            ends, begins = self.data == _NEW_LINE, (self.data & 0xC0) != 0x80
            self.tree[1:, 0] = np.add.reduceat(ends, starts, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(begins, starts, dtype=np.int64)
            for i in range(1, self.leaves + 1):  # every node hands its sums to its parent
                up = i + (i & -i)
                if up <= self.leaves:
                    self.tree[up] += self.tree[i]
        ended, self.chars = self.total()
        self.units = ended + int(len(self.data) > 0 and self.data[-1] != _NEW_LINE)

    def total(self) -> tuple[int, int]:
        i, sums = self.leaves, np.zeros(2, np.int64)
        while i:
            sums += self.tree[i]
            i &= i - 1
        return int(sums[0]), int(sums[1])

    def cut(self, units: int) -> tuple[int, int]:
        """(byte, code point) at which the first ``units`` units end."""
        if units <= 0:
            return 0, 0
        if units >= self.units:
            return len(self.data), self.chars
        at, sums = 0, np.zeros(2, np.int64)
        step = 1 << max(0, self.leaves.bit_length() - 1)
        while step:
            below = at + step
            if below <= self.leaves and sums[0] + self.tree[below, 0] < units:
                at, sums = below, sums + self.tree[below]
            step >>= 1
        begin = at * self.block
        part = self.data[begin : begin + self.block]
        here = int(np.flatnonzero(part == _NEW_LINE)[units - int(sums[0]) - 1]) + 1
        return begin + here, int(sums[1] + np.count_nonzero((part[:here] & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(text: str | None, doc_id: int | None, block: int = BLOCK, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix code points, middle code points, output) of one text."""
    text = text or ""
    data = text.encode()
    tree = BlockTree(data, block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return tree.units, "plain", None, None, text
    first, last = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (a, prefix_chars), (b, middle_end) = tree.cut(first), tree.cut(last)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    if h4 % 100 < spm_rate:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return tree.units, form, prefix_chars, middle_end - prefix_chars, output


def restore(output: str, form: str) -> str:
    """The text that was transformed, from its output and form alone."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, _, second = head.removeprefix(one).partition(two)
    return first + middle + second if form == "psm" else second + middle + first


_RESULTS = (("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()))


def transformed(docs: DataFrame, block: int = BLOCK, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """All columns of ``docs``, then n_units, form, prefix_chars, middle_chars and output; no shuffle."""
    names = [n for n, _ in _RESULTS]
    kept = [f.name for f in docs.schema if f.name.lower() not in names]
    # the caller's columns travel as one, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in kept)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            bare = pa.RecordBatch.from_arrays([row, row.field("text")], ["row", "text"])
            for part in slices(bare, "text"):
                row = part.column("row")
                out = [transform(t.as_py(), i.as_py(), block, seed, rate, spm_rate) for t, i in zip(part.column("text"), row.field("doc_id"), strict=True)]
                yield pa.RecordBatch.from_arrays([row, *(pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(_RESULTS))], ["row", *names])

    schema = T.StructType([rows.schema["row"], *(T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in _RESULTS)])
    return rows.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in kept), *names)


def restored(rows: DataFrame) -> DataFrame:
    """Rows of ``transformed`` with the text that their output and form give back, as ``restored``; no shuffle."""

    @F.pandas_udf("string")
    def back(output, form):
        return output.combine(form, restore)

    return rows.withColumn("restored", back("output", "form"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form, cuts and digests of every document."""
    rows = restored(transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return rows.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id::VARCHAR) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         cast('0x' || substr(h, 1, 8) AS BIGINT) AS h1, cast('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         cast('0x' || substr(h, 17, 8) AS BIGINT) AS h3, cast('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, text, lines, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": _SQL}
