"""Checks of uploads, pages and requests before any work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.text import strip

LARGEST_UPLOAD = 50 * 1024 * 1024
METADATA_FIELDS, LONGEST_FIELD = ("tenant", "landlord", "start_date", "end_date", "rent_amount", "location"), 200


def textless(pages: DataFrame) -> DataFrame:
    """n_pages, n_chars and accepted of every lease; without any character it is rejected."""
    n = F.sum(F.length(strip(F.coalesce("text", F.lit("")))))
    return pages.groupBy("lease_id").agg(F.count("*").alias("n_pages"), n.alias("n_chars"), (n > 0).alias("accepted"))


def split_textless(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages of accepted leases, rejected leases with the reason)."""
    known = textless(pages)
    good = pages.join(known.where("accepted").select("lease_id"), "lease_id", "left_semi")
    return good, known.where("not accepted").select("lease_id", F.lit("no extractable text").alias("reason"))


def gate_uploads(files: DataFrame, most: int = LARGEST_UPLOAD) -> DataFrame:
    """Adds ``reason``, null for an accepted file: type, then size, then the first bytes."""
    return files.withColumn(
        "reason",
        F.when(F.coalesce("mime", F.lit("")) != "application/pdf", "type").when(F.col("length") > most, "size").when(F.coalesce(F.hex(F.substring("content", 1, 4)), F.lit("")) != "25504446", "signature"),
    )


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(bad, name) for bad, name in checks)))


def requests(df: DataFrame) -> DataFrame:
    """Adds ``errors``, the names of the rules that (lease_id, question, name) break."""
    question = strip(F.coalesce("question", F.lit("")))
    name = F.coalesce("name", F.lit(""))
    return df.withColumn(
        "errors",
        _errors(
            (~F.coalesce("lease_id", F.lit("")).rlike(r"\A[A-Za-z0-9_-]{1,100}\z"), "lease_id"),
            (F.length(question) == 0, "question_blank"),
            (F.length(question) > 1000, "question_long"),
            (F.length(F.trim(name)) == 0, "name_blank"),
            (F.length(name) > 200, "name_long"),
        ),
    )


def pairs(df: DataFrame) -> DataFrame:
    """Adds ``errors`` for (left_id, right_id): two distinct valid ids."""
    ok = [F.coalesce(c, F.lit("")).rlike(r"\A[A-Za-z0-9_-]{1,100}\z") for c in ("left_id", "right_id")]
    return df.withColumn("errors", _errors((~ok[0], "left_id"), (~ok[1], "right_id"), (F.col("left_id").eqNullSafe(F.col("right_id")), "same_lease")))


def metadata_fields(df: DataFrame, fields: tuple[str, ...] = METADATA_FIELDS, most: int = LONGEST_FIELD) -> DataFrame:
    """Adds ``errors``, the names of the metadata fields that are longer than ``most`` once stripped; none has to be there."""
    return df.withColumn("errors", _errors(*((F.length(strip(F.coalesce(f, F.lit("")))) > most, f) for f in fields)))
