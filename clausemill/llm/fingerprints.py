"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A shingle is five consecutive words, or the whole sequence of a text with fewer.  Its
hash is the first 64 bits of its MD5 as 16 hexadecimal digits, so hashes sort as
numbers do.  A sketch is the sorted array of the ``K`` smallest distinct hashes of a
set, and a fingerprint is their digits in a row.

The smallest hashes of a union are among the smallest hashes of its parts, so
sketches of parts merge to the sketch of the whole (``union``, ``merged``).  They
estimate, and give exactly for sets of under ``K`` shingles:

  distinct     the number of distinct shingles, from how far the K-th hash reaches
  resemblance  shared shingles among those of both, from the K smallest of the union
  containment  the share of one set's shingles that the other has, from the same

``edited`` puts every document beside the next one, by ascending doc_id, without a
window over the whole table: quantiles of the ids cut the table into ranges, the first
row of each range is sent to the range before it too, and a window inside each range
finds the rest.  Texts are shuffled once.

Defined results: a null text is an empty text; a text without words has an empty
sketch; two empty sets resemble each other fully and an empty set is contained in any,
while an empty and a full set resemble each other not at all.  In ``edited``, rows
that share a doc_id follow each other in the order of a hash of their texts; a row
with a null doc_id has no next document; the next of a single document is itself;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a shingle, and hashes of a sketch.
WIDTH = 5
K = 128
#: Digits of a hash.
DIGITS = 16
#: Most ranges of ids; more rows make longer ranges, of which a task sorts and spills as many rows as it must.
RANGES = 20_000
SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def sketch(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest distinct shingle hashes of an array of words, sorted."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
    hashes = F.transform(starts, lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(words, i, width))), 1, DIGITS))
    return F.when(F.size(words) > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<string>"))


def fingerprint(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def hashes(fingerprint: Column) -> Column:
    """The sketch that a fingerprint was made of."""
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = union(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has; null where none of a's hashes is among the union's smallest."""
    both = F.array_intersect(union(a, b, k), a)
    return F.when(F.size(a) == 0, 1.0).when(F.size(both) > 0, F.size(F.array_intersect(both, b)) / F.size(both))


def distinct(sketch: Column, k: int = K) -> Column:
    """The number of distinct shingles: counted, or beyond k estimated by the reach of the k-th hash."""
    reach = F.conv(F.element_at(sketch, -1), 16, 10).cast("double") / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / reach)


def fingerprinted(docs: DataFrame, k: int = K) -> DataFrame:
    """All columns of ``docs``, with ``fingerprint``; no shuffle."""
    return docs.withColumn("fingerprint", fingerprint(sketch(words(F.col("text")), k)))


def merged(prints: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """The fingerprint of each group of fingerprints, as that of the union of their sets.

    Each task keeps a group's k smallest hashes before the shuffle (a limit on ranks
    reaches below the exchange), so a group of any size arrives as k rows a task.
    """
    each = prints.select(*keys, F.explode(hashes(F.col("fingerprint"))).alias("h")).distinct()
    least = each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("rank") <= k)
    found = least.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("h")), "").alias("fingerprint"))
    # groups of empty sets have no hash at all
    groups = prints.select(*keys).distinct()
    same = [groups[c].eqNullSafe(found[c]) for c in keys]
    return groups.join(found, same, "left").select(*(groups[c] for c in keys), F.coalesce(found["fingerprint"], F.lit("")).alias("fingerprint"))


def _table(values: list[int]) -> Column:
    """A literal array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _rank(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``value``, by halving steps."""
    if not bounds:
        return F.lit(0)
    table, steps = _table(bounds), F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def _edit(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by as many from the start of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edited(docs: DataFrame, k: int = K, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited (the text), sketch, edited_sketch and next_sketch of every document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = ranges or min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = rows.where("doc_id is not null")
    cuts = known.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 10 * ranges))).first()[0] or []
    at = _rank(F.col("doc_id"), sorted(set(cuts)))
    firsts = sorted(known.groupBy(at.alias("range")).agg(F.min("doc_id").alias("first")).collect()) or [(0, 0)]  # one row a range
    target = {r: before for (before, _), (r, _) in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)}
    spread = range(firsts[-1][0] + 1)
    first_of, first = _table([dict(firsts).get(r, 0) for r in spread]), F.col("doc_id")
    guest = F.when(F.get(first_of, F.col("range")) == first, F.struct(F.get(_table([target.get(r, 0) for r in spread]), F.col("range")).cast("int").alias("range"), F.lit(True).alias("guest")))
    home = F.struct(F.col("range"), F.lit(False).alias("guest"))
    placed = known.withColumn("range", at).withColumn("tie", F.xxhash64("text")).withColumn("place", F.explode(F.array_compact(F.array(home, guest))))
    placed = placed.select("place.range", "place.guest", "doc_id", "tie", "text")
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "tie")
    beside = placed.withColumn("following", F.lead("text").over(order))
    shown = _sketched(beside, k, "range", "guest", "doc_id", "tie")
    shown = shown.withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("guest"))
    alone = _sketched(rows.where("doc_id is null").withColumn("following", F.lit("")), k, "doc_id").withColumn("next_sketch", F.array().cast("array<string>"))
    names = ("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
    return shown.select(*names).unionByName(alone.select(*names))


def _sketched(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The keys, n_chars, edited and both sketches of rows with text and following."""
    rows = rows.select(*keys, F.length("text").cast("long").alias("n_chars"), words(F.col("text")).alias("w"), _edit(F.col("text"), F.coalesce("following", F.lit(""))).alias("edited"))
    rows = rows.select(*keys, "n_chars", "edited", sketch(F.col("w"), k).alias("sketch"), words(F.col("edited")).alias("w"))
    return rows.select(*keys, "n_chars", "edited", "sketch", sketch(F.col("w"), k).alias("edited_sketch"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are."""
    rows = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def _near_sql(a: str, b: str) -> str:
    both = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{K}]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect({both}, {a}), {b})) / len({both})::DOUBLE END"


_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM d
), e AS (
  SELECT doc_id, text, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited FROM n
), w AS (
  SELECT doc_id, text, edited, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') AS b FROM e
), s AS (
  SELECT doc_id, text, edited,
         CASE WHEN len(a) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct([substr(md5(array_to_string(a[i:i + {WIDTH - 1}], ' ')), 1, {DIGITS}) FOR i IN range(1, greatest(len(a) - {WIDTH - 2}, 2))]))[1:{K}] END AS sa,
         CASE WHEN len(b) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct([substr(md5(array_to_string(b[i:i + {WIDTH - 1}], ' ')), 1, {DIGITS}) FOR i IN range(1, greatest(len(b) - {WIDTH - 2}, 2))]))[1:{K}] END AS sb
  FROM w
), x AS (
  SELECT *, coalesce(lead(sa) OVER (ORDER BY doc_id), first_value(sa) OVER (ORDER BY doc_id)) AS sn FROM s
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(sa, '') AS fingerprint, array_to_string(sb, '') AS edited_fingerprint,
       {_near_sql('sa', 'sb')} AS near_edited, {_near_sql('sa', 'sn')} AS near_next
FROM x
"""

QUERIES = {"op11_fingerprints": op11_fingerprints}
ORACLES = {"op11_fingerprints": _SQL}
