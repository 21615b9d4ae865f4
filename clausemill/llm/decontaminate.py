"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A fixed mask names the token positions that are hashed; the others may differ.
The two masks below are lossless for an aligned window of 12 words with at most
two substitutions: wherever the two fall, some placement of some mask avoids
both (``tests/llm`` tries all placements).  Hits of equal hashes are verified on
their diagonal, so the result is exact: (document, item) pairs with an aligned
window of ``WINDOW`` words of which at most ``SUBSTITUTIONS`` differ.

Words are maximal runs of characters other than white space, A-Z lower-cased.

Defined results: null or empty text, rows with a null doc_id and items under
``WINDOW`` words match nothing; repeated rows with one id count as one document;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved

WINDOW = 12
SUBSTITUTIONS = 2
MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 6))
#: Test items whose words are at most this many are sent to every executor; a larger test set is joined by a shuffle.
BROADCAST_WORDS = 400_000
#: Ids of documents with a hit, up to this many (some 20 bytes each once hashed, 8 MB), are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded_words(text: Column) -> Column:
    """Lower-cased words of a text; an empty array for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _placements(words: Column, k: int, mask: tuple[int, ...]) -> Column:
    places = F.sequence(F.lit(0), F.size(words) - 1 - mask[-1])
    hashed = F.transform(places, lambda i: F.struct(F.lit(k).alias("mask"), i.alias("at"), F.xxhash64(*(F.get(words, i + m) for m in mask)).alias("hash")))
    return F.when(F.size(words) > mask[-1], hashed).otherwise(F.array().cast("array<struct<mask:int,at:int,hash:bigint>>"))


def _seeds(words: Column) -> Column:
    """(mask, at, hash) of every placement of every mask in an array of words."""
    return F.concat(*(_placements(words, k, mask) for k, mask in enumerate(MASKS)))


def _verified(pairs: DataFrame) -> DataFrame:
    """Keep diagonals with a close window. In: doc_id, words, item_id, item, diagonal."""
    part = pairs.select(
        "doc_id",
        "item_id",
        F.size("item").alias("item_words"),
        F.transform("item", lambda w, j: F.coalesce(F.get("words", F.col("diagonal") + j) == w, F.lit(False)).cast("int")).alias("same"),
    )
    sums = F.transform(
        F.sequence(F.lit(1), F.col("item_words") - WINDOW + 1),
        lambda s: F.aggregate(F.slice("same", s, WINDOW), F.lit(0), lambda a, x: a + x),
    )
    return (
        part.where(F.col("item_words") >= WINDOW)
        .where(F.array_max(sums) >= WINDOW - SUBSTITUTIONS)
        .select("doc_id", "item_id", "item_words", F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("n_matched"))
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, n_matched): verified overlaps.

    ``n_matched`` is the most aligned equal words on one diagonal that holds a
    close window.
    """
    items = benchmark.select("item_id", folded_words(F.col("text")).alias("item")).where(F.size("item") >= WINDOW)
    seeds = items.select("item_id", F.inline(_seeds(F.col("item")))).withColumnRenamed("at", "item_at")
    texts = docs.select("doc_id", folded_words(F.col("text")).alias("words")).where(F.size("words") >= WINDOW - SUBSTITUTIONS)
    placed = texts.select("doc_id", F.inline(_seeds(F.col("words"))))  # the words stay behind: only hashes are exploded
    size = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    hits = placed.join(F.broadcast(seeds) if size <= BROADCAST_WORDS else seeds, ["mask", "hash"])
    found = saved(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "diagonals")
    ids = saved(found.select("doc_id").distinct(), "ids")
    hit = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    pairs = found.join(items, "item_id").join(hit.select("doc_id", folded_words(F.col("text")).alias("words")), "doc_id")
    return _verified(pairs).groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("n_matched").alias("n_matched"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified overlap, columns as they are."""
    found = overlaps(docs, benchmark).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL = rf"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents)
), b AS (
  SELECT item_id, len(w) AS item_words, unnest(w) AS word, generate_subscripts(w, 1) AS j
  FROM (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
  WHERE len(w) >= {WINDOW}
), m AS (
  SELECT doc_id, item_id, item_words, i - j AS diagonal, j,
         count(*) OVER (PARTITION BY doc_id, item_id, i - j ORDER BY j RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS close,
         count(*) OVER (PARTITION BY doc_id, item_id, i - j) AS n
  FROM d JOIN b USING (word)
)
SELECT doc_id, item_id, max(item_words)::INT AS item_words, max(n)::INT AS n_matched
FROM m WHERE close >= {WINDOW - SUBSTITUTIONS} GROUP BY doc_id, item_id
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": _SQL}
