"""Token counts as delta-maintained rollups.

A batch of changes inserts, revises or deletes the counts of documents, each for
one tokenizer version.  Joined with the ledger of counts in force, a change
becomes signed rows: minus the old count, plus the new one.  Their sums by source,
language and tokenizer are the batch's delta; totals are the sum of the deltas of
all committed batches.

The ledger lies in PARTS folders by a hash of doc_id.  A batch reads those of its own
documents alone, and there the earlier changes are joined with the batch's keys before
they are grouped.  ``compact`` rewrites the counts in force and the totals as one base,
after which earlier batches are not read again.

A commit writes the batch's delta and its part of the ledger under the batch's
own name, replacing what an unfinished attempt left there, and last a marker.  A
batch whose marker exists is not applied again, so a retry or a replay changes
nothing.

Defined results: a delete or a revision of an unknown document acts as nothing or
as an insert; of several changes of one (doc_id, tokenizer) in one batch the
largest (deleted, n_tokens, source, lang) counts; rows with a null doc_id only
ever add, one for one; null source or lang is a group of its own; groups whose
documents are all gone stay with zeros; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .tables import drop, new_path, saved

_LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, deleted boolean, seq long"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_GROUP = ("source", "lang", "tokenizer")
#: Folders of each batch of the ledger.
PARTS = 16


def _part():
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)), F.lit(0)).cast("int")


class TokenRollups:
    """Ledger, deltas and commit markers under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Batches in the order of their commits."""
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return [n.split("-", 1)[1] for n in sorted(names)]

    def _base(self) -> int:
        """Number of commits that the latest base holds."""
        folder = self._path(f"{self.path}/bases")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 0

    def _read(self, kind: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        base, done = self._base(), self.committed()
        paths = [f"{self.path}/{kind}-base/{base}"] * (base > 0) + [f"{self.path}/{kind}/{batch}" for batch in done[base:]]
        if kind == "ledger":
            paths = [f"{p}/part={k}" for p in paths for k in (range(PARTS) if parts is None else parts) if self._fs.exists(self._path(f"{p}/part={k}"))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        # one task has all of a part, or several have a large one; small ones share a task
        rows.withColumn("part", _part()).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(path)

    def compact(self) -> None:
        """Write counts in force and totals as a base; its marker comes last, so an unfinished one is never read."""
        done = len(self.committed())
        if done == self._base():
            return
        unnamed = self._read("ledger", _LEDGER).where("doc_id is null")
        kept = self.current().withColumns({"deleted": F.lit(False), "seq": F.lit(done - 1).cast("long")}).unionByName(unnamed)
        self._write(kept, f"{self.path}/ledger-base/{done}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/deltas-base/{done}")
        self._fs.mkdirs(self._path(f"{self.path}/bases/{done}"))

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """Counts in force, of all documents or those of (doc_id, tokenizer) keys: the latest change of each."""
        parts = None if keys is None else [r.part for r in keys.select(_part().alias("part")).distinct().collect()]  # PARTS at most
        rows = self._read("ledger", _LEDGER, parts).where("doc_id is not null")
        if keys is not None:
            rows = rows.join(keys, ["doc_id", "tokenizer"], "left_semi")
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "n_tokens", "deleted"), "seq").alias("r"))
        return last.where("not r.deleted").select("doc_id", "tokenizer", "r.source", "r.lang", "r.n_tokens")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply (doc_id, tokenizer, source, lang, n_tokens, deleted); False if the batch is in already."""
        done = self.committed()
        if batch in done:
            return False
        rows = changes.select("doc_id", "tokenizer", "source", "lang", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
        one = rows.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(F.struct("deleted", "n_tokens", "source", "lang")).alias("r"))
        one = one.select("doc_id", "tokenizer", "r.source", "r.lang", "r.n_tokens", "r.deleted")
        ledger = f"{self.path}/ledger/{batch}"
        self._write(one.unionByName(rows.where("doc_id is null")).withColumn("seq", F.lit(len(done)).cast("long")), ledger)
        new = self.spark.read.schema(_LEDGER).parquet(ledger)
        old = self.current(new.select("doc_id", "tokenizer"))
        signed = old.select(*_GROUP, F.lit(-1).alias("sign"), "n_tokens").unionByName(new.where("not deleted").select(*_GROUP, F.lit(1).alias("sign"), "n_tokens"))
        delta = signed.groupBy(*_GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        self._fs.mkdirs(self._path(f"{self.path}/commits/{len(done):08d}-{batch}"))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens)."""
        rows = self._read("deltas", _DELTA)
        return rows.groupBy(*_GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _changes(counts: DataFrame, tokenizer: str, deleted: bool = False) -> DataFrame:
    return counts.select("doc_id", F.lit(tokenizer).alias("tokenizer"), "source", "lang", "n_tokens", F.lit(deleted).alias("deleted"))


def rolled_up(docs: DataFrame, ranks_path: str, path: str) -> TokenRollups:
    """A store filled from ``docs`` in four batches.

    1. ``insert``: words of every row, and of rows with a doc_id a provisional BPE
       count of a quarter of the bytes.  The store is compacted after it.
    2. ``delete``: every third document, as if it had been taken back.
    3. ``restore``: the words of those documents again.
    4. ``revise``: the exact BPE counts, of the deleted documents too.  Rows without
       a doc_id cannot be revised, so they come in here and never have a provisional
       count.
    The first batch is then sent again, as after a lost reply.
    """
    store = TokenRollups(docs.sparkSession, path)
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "source", "lang", text.alias("text"))
    named = base.where("doc_id is not null")
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    words = base.select("doc_id", "source", "lang", n_words.alias("n_tokens"))
    guess = named.select("doc_id", "source", "lang", F.ceil(F.octet_length("text") / 4).cast("long").alias("n_tokens"))
    insert = _changes(words, "words").unionByName(_changes(guess, "byte_bpe_50k"))
    store.commit("insert", insert)
    store.compact()
    third = F.col("doc_id") % 3 == 0
    gone = saved(store.current().where(third), "taken-back")  # counts, no texts
    store.commit("delete", gone.withColumn("deleted", F.lit(True)))
    store.commit("restore", gone.where("tokenizer = 'words'").withColumn("deleted", F.lit(False)))
    drop(gone)
    exact = bpe.token_counts(named, ranks_path).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    known = named.groupBy("doc_id").agg(F.max(F.struct("source", "lang")).alias("r")).select("doc_id", "r.source", "r.lang")
    # a number stands for the missing id while they are counted; written, so that it stays the same
    unnamed = saved(base.where("doc_id is null").withColumn("doc_id", F.monotonically_increasing_id()), "rows-without-id")
    alone = unnamed.drop("text").join(bpe.token_counts(unnamed, ranks_path), "doc_id").withColumn("doc_id", F.lit(None).cast("long"))
    store.commit("revise", _changes(known.join(exact, "doc_id").unionByName(alone), "byte_bpe_50k"))
    drop(unnamed)
    store.commit("insert", insert)
    return store


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rolled_up(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), new_path(spark, "token-rollups")).totals()


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
