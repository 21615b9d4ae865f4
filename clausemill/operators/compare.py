"""Two leases clause by clause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.functions.redaction import redact_pii, sanitize_chunk
from clausemill.functions.text import strip, tokens

PER_GROUP, EXCERPT, JOINED = 20, 300, 4000
# Sentences that are put out.
DIFFERENCE, INSIGHT = "Present in %s but missing from %s", "'%s' clause found only in %s, not in %s."
ABSENT = "Not present"


def group_clauses(chunks: DataFrame, most: int = PER_GROUP, group: str = "clause_type") -> DataFrame:
    """The first ``most`` chunks of each lease and clause type, with ``n`` from 1."""
    rows = chunks.withColumn(group, F.coalesce(group, F.lit("other")))
    w = Window.partitionBy("lease_id", group).orderBy("chunk_no")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def _sides(pairs: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(pairs.select("pair_id", F.col(f"{s}_id").alias("lease_id")).join(groups, "lease_id").drop("lease_id") for s in ("left", "right"))


def clause_overlap(pairs: DataFrame, groups: DataFrame, group: str = "clause_type") -> DataFrame:
    """(pair_id, clause type, side): shared, left or right."""
    left, right = _sides(pairs, groups.select("lease_id", group).distinct())
    both = left.withColumn("l", F.lit(True)).join(right.withColumn("r", F.lit(True)), ["pair_id", group], "full_outer")
    return both.select("pair_id", group, F.when(F.col("l") & F.col("r"), "shared").when(F.col("l"), "left").otherwise("right").alias("side"))


def one_sided_diffs(pairs: DataFrame, groups: DataFrame, group: str = "clause_type", ascii: bool = False) -> DataFrame:
    """(pair_id, clause type, left_value, right_value, difference, insight) where one side has no such clause; ``ascii`` as in ``redact_pii``."""
    first = groups.groupBy("lease_id", group).agg(redact_pii(F.substring(F.min_by("text", "chunk_no"), 1, EXCERPT), ascii=ascii).alias("excerpt"))
    left, right = _sides(pairs, first)
    both = left.withColumnRenamed("excerpt", "l").join(right.withColumnRenamed("excerpt", "r"), ["pair_id", group], "full_outer").where("l is null or r is null")
    both = both.join(pairs.select("pair_id", "left_id", "right_id"), "pair_id")
    has = F.when(F.col("r").isNull(), F.col("left_id")).otherwise(F.col("right_id"))
    lacks = F.when(F.col("r").isNull(), F.col("right_id")).otherwise(F.col("left_id"))
    return both.select(
        "pair_id", group, F.coalesce("l", F.lit(ABSENT)).alias("left_value"), F.coalesce("r", F.lit(ABSENT)).alias("right_value"),
        F.format_string(DIFFERENCE, has, lacks).alias("difference"), F.format_string(INSIGHT, F.col(group), has, lacks).alias("insight"),
    )


def _joined(groups: DataFrame, group: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", sanitize_chunk("text").alias("t")))), lambda x: x["t"])  # at most PER_GROUP chunks
    return groups.groupBy("lease_id", group).agg(F.substring(F.concat_ws("\n\n", texts), 1, JOINED).alias("text"))


def shared_clause_pairs(pairs: DataFrame, groups: DataFrame, group: str = "clause_type") -> DataFrame:
    """(pair_id, clause type, left_text, right_text) of shared clause types."""
    left, right = _sides(pairs, _joined(groups, group))
    return left.withColumnRenamed("text", "left_text").join(right.withColumnRenamed("text", "right_text"), ["pair_id", group])


def _amounts(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))


def shared_clause_delta(shared: DataFrame, group: str = "clause_type") -> DataFrame:
    """Token-set Jaccard and what only one side has, of shared clause pairs."""
    rows = shared.select("pair_id", group, *(f(c).alias(n) for n, f, c in (("lt", lambda c: F.array_distinct(tokens(c)), "left_text"), ("rt", lambda c: F.array_distinct(tokens(c)), "right_text"), ("la", _amounts, "left_text"), ("ra", _amounts, "right_text"))))
    union = F.size(F.array_union("lt", "rt"))
    return rows.select(
        "pair_id", group, F.when(union > 0, F.size(F.array_intersect("lt", "rt")) / union).otherwise(1.0).alias("jaccard"),
        *(F.sort_array(F.array_except(a, b)).alias(n) for n, a, b in (("left_tokens", "lt", "rt"), ("right_tokens", "rt", "lt"), ("left_amounts", "la", "ra"), ("right_amounts", "ra", "la"))),
    )


RESULT = "differences array<struct<clause_type:string,lease1_value:string,lease2_value:string,difference:string>>"


def collect_comparison(results: DataFrame, one_sided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(difference rows, one status row a pair) of result JSON by (pair_id, clause_type, raw)."""
    from .answers import parse_model_json

    rows = results.withColumn("r", parse_model_json("raw", RESULT)).withColumn("ok", F.col("r").isNotNull() & F.col("r.differences").isNotNull())
    diffs = rows.where("ok").select("pair_id", F.col("clause_type").alias("own"), F.explode("r.differences").alias("d"))
    diffs = diffs.select("pair_id", F.coalesce(F.nullif(strip("d.clause_type"), F.lit("")), F.col("own")).alias("clause_type"), F.col("d.lease1_value").alias("left_value"), F.col("d.lease2_value").alias("right_value"), "d.difference")
    status = rows.groupBy("pair_id").agg(F.count("*").alias("attempted"), F.count_if(~F.col("ok")).alias("failed"))
    sided = one_sided.groupBy("pair_id").agg(F.count("*").alias("one_sided"))
    status = status.join(sided, "pair_id", "full_outer").na.fill(0)
    note = F.when(F.col("failed") > 0, F.concat_ws("/", "failed", "attempted"))
    dead = (F.col("attempted") > 0) & (F.col("failed") == F.col("attempted")) & (F.col("one_sided") == 0)
    return diffs, status.select("pair_id", "attempted", "failed", dead.alias("pair_failed"), note.alias("note"))


def missing_leases(pairs: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pair_id, lease_id, reason) of sides without a record or without chunks."""
    sides = pairs.select("pair_id", F.explode(F.array("left_id", "right_id")).alias("lease_id"))
    no_record = sides.join(records.select("lease_id").distinct(), "lease_id", "left_anti").select("pair_id", "lease_id", F.lit("no record").alias("reason"))
    known = sides.join(records.select("lease_id").distinct(), "lease_id", "left_semi")
    return no_record.unionByName(known.join(chunks.select("lease_id").distinct(), "lease_id", "left_anti").select("pair_id", "lease_id", F.lit("no chunks").alias("reason")))
