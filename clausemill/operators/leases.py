"""Lease records: metadata, status, paging, retention and purge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.functions.text import strip
from clausemill.sources.tables import saved

from .answers import json_object
from .retrieval import bounded

UNKNOWN = "Unknown"
FIELDS = ("tenant", "landlord", "start_date", "end_date", "rent_amount", "location")
#: Words of the signals for metadata (fixed values), in priority order: signature and name lines, terms of fields, words for the parties; ``*`` stands for any word ending.
IDENTITY, TERMS, PARTY_WORDS = (
    ("landlord signature", "tenant signature", "approved occupants", "name:"),
    ("base rent", "monthly rent", "rent", "commenc*", "expir*", "lease term", "property address", "premises located", "address"),
    ("tenant", "lessee", "landlord", "lessor"),
)


def signal(words: Sequence[str], start: str = r"\b", end: str = r"\b") -> str:
    """A pattern of any of the words, whatever the case; white space between them and before a colon is free."""
    return "(?i)" + start + "(?:" + "|".join(w.replace(" ", r"\s+").replace("*", r"\w*").replace(":", r"\s*:") for w in words) + ")" + end


#: Signals for metadata, in priority order.
SIGNALS = (
    signal(IDENTITY[:3], "", "") + "|" + signal(IDENTITY[3:], end="").removeprefix("(?i)"),
    signal(TERMS),
    signal(PARTY_WORDS),
)
FIELD_PATTERNS = {
    "tenant": r"(?im)\b(?:tenant|lessee)(?:\s+name)?\s*:\s*([^\n;]+)",
    "landlord": r"(?im)\b(?:landlord|lessor)(?:\s+name)?\s*:\s*([^\n;]+)",
    "start_date": r"(?im)\b(?:start|commencement)\s+date\s*:\s*([^\n;]+)",
    "end_date": r"(?im)\b(?:end|expiration|expiry)\s+date\s*:\s*([^\n;]+)",
    "rent_amount": r"(?im)\b(?:monthly\s+)?rent(?:\s+amount)?\s*:\s*([^\n;]+)",
    "location": r"(?im)\b(?:address|location|premises)\s*:\s*([^\n;]+)",
}
DAY = 86_400
#: Pages that end within so many rows are taken by a top-n.
SHALLOW = 10_000


def select_metadata_chunks(chunks: DataFrame, first: int = 5, most: int = 12, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """(lease_id, chunk_no, chosen): the first chunks, then signal matches and their successors, at most ``most``.

    Only ``most`` chunks can be chosen, so of each signal the first ``most`` matches
    do; ranks with such a limit are cut before the shuffle.  A successor is the
    smallest number after a match, an aggregate.  No window holds a whole lease.
    """
    flags = chunks.select("lease_id", "chunk_no", *(F.col("text").rlike(p).alias(f"s{k}") for k, p in enumerate(signals)))
    order = Window.partitionBy("lease_id").orderBy("chunk_no")
    head = flags.select("lease_id", "chunk_no").withColumn("n", F.row_number().over(order)).where(F.col("n") <= first).drop("n")
    named = F.array_compact(F.array(*(F.when(F.col(f"s{k}"), F.lit(k)) for k in range(len(signals)))))
    matches = flags.select("lease_id", "chunk_no", F.explode(named).alias("p")).withColumn("n", F.row_number().over(Window.partitionBy("lease_id", "p").orderBy("chunk_no")))
    matches = saved(matches.where(F.col("n") <= most).drop("n"), "matches")
    known = matches.groupBy("lease_id").agg(F.collect_set("chunk_no").alias("known"))  # at most ``most`` for each signal
    after = chunks.select("lease_id", "chunk_no").join(known, "lease_id").withColumn("m", F.array_max(F.filter("known", lambda x: x < F.col("chunk_no"))))
    after = after.where("m is not null").groupBy("lease_id", "m").agg(F.min("chunk_no").alias("next"))
    own = matches.select("lease_id", "chunk_no", F.struct("p", F.col("chunk_no").alias("i"), F.lit(0).alias("o")).alias("key"))
    followed = matches.withColumnRenamed("chunk_no", "m").join(after, ["lease_id", "m"]).select("lease_id", F.col("next").alias("chunk_no"), F.struct("p", F.col("m").alias("i"), F.lit(1).alias("o")).alias("key"))
    extra = own.unionByName(followed).groupBy("lease_id", "chunk_no").agg(F.min("key").alias("key")).join(head, ["lease_id", "chunk_no"], "left_anti")
    w = Window.partitionBy("lease_id").orderBy("key", "chunk_no")
    extra = extra.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most - first)
    return head.withColumn("chosen", F.lit("first")).unionByName(extra.select("lease_id", "chunk_no", F.lit("signal").alias("chosen")))


def extract_metadata(chunks: DataFrame, patterns: dict[str, str] = FIELD_PATTERNS, leases: DataFrame | None = None) -> DataFrame:
    """The six fields of each lease by label, the first non-empty by chunk order, and a status.

    ``updated`` with some field, ``no_fields`` without; of the given ``leases`` those
    without a chunk are ``failed``.
    """
    found = {f: F.nullif(strip(F.regexp_extract("text", p, 1)), F.lit("")) for f, p in patterns.items()}
    rows = chunks.select("lease_id", "chunk_no", *(c.alias(f) for f, c in found.items()))
    out = rows.groupBy("lease_id").agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col("chunk_no"))).alias(f) for f in patterns))
    some = reduce(lambda a, b: a | b, (F.col(f).isNotNull() for f in patterns))
    out = out.withColumn("status", F.when(some, "updated").otherwise("no_fields"))
    if leases is None:
        return out
    return leases.select("lease_id").distinct().join(out, "lease_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def parse_metadata(df: DataFrame, raw: str = "raw", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The six fields of result JSON and a status: ``failed`` for no object, another key or a value that is no string or null."""
    text = json_object(raw)
    value = F.try_parse_json(text)
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")), F.lit("VOID")) for f in fields]
    known = F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, fields)))) == 0
    good = text.isNotNull() & known & reduce(lambda a, b: a & b, (k.isin("STRING", "VOID") for k in kinds))
    rows = df.withColumn("_r", F.when(good, F.from_json(text, ", ".join(f"{f} string" for f in fields))))
    some = reduce(lambda a, b: a | b, (F.col(f"_r.{f}").isNotNull() for f in fields))
    status = F.when(F.col("_r").isNull(), "failed").when(some, "updated").otherwise("no_fields")
    return rows.select(*(c for c in df.columns if c != raw), *(F.col(f"_r.{f}").alias(f) for f in fields), status.alias("status"))


def _unknown(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "") | (c == UNKNOWN)


def merge_metadata(leases: DataFrame, patch: DataFrame, missing_only: bool = False, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Leases with the patch applied and the list ``changed``; patches of unknown leases give no row.

    An update overwrites what it gives unless that is the placeholder; with
    ``missing_only`` only unknown fields are filled, by known values.
    """
    new = patch.select("lease_id", *(F.col(f).alias(f"_{f}") for f in fields))
    rows = leases.join(new, "lease_id", "left")
    takes = {}
    for f in fields:
        given = F.col(f"_{f}")
        ok = ~_unknown(given) & _unknown(F.col(f)) if missing_only else given.isNotNull() & (given != UNKNOWN)
        takes[f] = F.coalesce(ok, F.lit(False))
    changed = F.array_compact(F.array(*(F.when(takes[f] & ~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields)))
    values = {f: F.when(takes[f], F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields}
    return rows.select(*(values.get(c, F.col(c)) for c in leases.columns), changed.alias("changed"))


def register_leases(rows: DataFrame) -> DataFrame:
    """The last write of each lease."""
    columns = [c for c in rows.columns if c != "lease_id"]
    return rows.groupBy("lease_id").agg(F.max_by(F.struct(*columns), "written").alias("r")).select("lease_id", "r.*")


def list_leases(leases: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """(a page of the registered leases, newest first, their number); leases without a time come last."""
    return page_rows(leases, [F.col("created_at").desc_nulls_last(), F.col("lease_id")], page, size)


def get_leases(leases: DataFrame, wanted: DataFrame) -> DataFrame:
    """The record of each wanted ``lease_id``, all null for an unknown one; few ids are looked up in the scan."""
    return bounded(wanted.select("lease_id").distinct()).join(leases, "lease_id", "left").select(*leases.columns)


def lease_status() -> Column:
    """pending while start, end or rent is unknown."""
    return F.when(_unknown(F.col("start_date")) | _unknown(F.col("end_date")) | _unknown(F.col("rent_amount")), "pending").otherwise("active")


def portfolio_stats(leases: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """One row: total, active, pending, active_pct, comparisons."""
    active = F.count_if(lease_status() == "active")
    stats = leases.agg(F.count("*").alias("total"), active.alias("active"), (F.count("*") - active).alias("pending"))
    stats = stats.withColumn("active_pct", F.when(F.col("total") > 0, F.round(100 * F.col("active") / F.col("total"))).otherwise(0.0).cast("long"))
    done = comparisons.agg(F.count("*").alias("comparisons")) if comparisons is not None else stats.select(F.lit(0).cast("long").alias("comparisons"))
    return stats.crossJoin(done)  # one row each


def age_label(days: Column) -> Column:
    """Today, n days, weeks and months."""
    weeks, months = F.floor(days / 7).cast("string"), F.floor(days / 30).cast("string")
    return (
        F.when(days <= 0, "Today").when(days == 1, "1 day").when(days < 7, F.concat(days.cast("string"), F.lit(" days"))).when(days < 14, "1 week").when(days < 30, F.concat(weeks, F.lit(" weeks")))
        .when(days < 60, "1 month").otherwise(F.concat(months, F.lit(" months")))
    )


def recent_leases(leases: DataFrame, today: str, n: int = 5) -> DataFrame:
    """The newest ``n``, with an age label."""
    days = F.datediff(F.lit(today).cast("date"), F.col("created_at").cast("date"))
    return leases.orderBy(F.col("created_at").desc(), "lease_id").limit(n).withColumn("age", age_label(days))


def search_leases(leases: DataFrame, query: str) -> DataFrame:
    """Name or tenant holds the text, whatever the case; blank finds all."""
    q = query.strip().lower()
    return leases if not q else leases.where(F.lower(F.coalesce("name", F.lit(""))).contains(q) | F.lower(F.coalesce("tenant", F.lit(""))).contains(q))


def page_rows(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20, clamp: bool = False, shallow: int = SHALLOW) -> tuple[DataFrame, int]:
    """(rows of a 1-based page, total); size is kept in 1 to 100, ``clamp`` goes back to the last page.

    Pages that end within ``shallow`` rows are a top-n.  For a deeper one the rows
    are sorted in ranges and written; the counts of the ranges tell which of them
    hold the page, and no task gets more than a range.  ``order`` must be total.
    """
    size, total = min(100, max(1, size)), df.count()
    page = max(1, page)
    if clamp:
        page = min(page, max(1, -(-total // size)))
    start = (page - 1) * size
    if start + size <= shallow or start >= total:
        return df.orderBy(*order).offset(start).limit(size) if start < total else df.limit(0), total
    place = F.monotonically_increasing_id()  # the range above 33 bits, the place in it below
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(place, 33), "_at": place.bitwiseAND(2**33 - 1)}), "ranges")
    here, before = F.lit(False), 0
    for r in sorted(rows.groupBy("_range").count().collect()):  # one row a range
        low, high = start - before, start + size - before
        if low < r["count"] and high > 0:
            here = here | (F.col("_range") == r["_range"]) & F.col("_at").between(low, high - 1)
        before += r["count"]
    return rows.where(here).drop("_range", "_at").orderBy(*order), total


def age_days(created_at: Column | str, now: str) -> Column:
    """Days since a time string; ``Z`` and naive are UTC (the session's zone); null for no or bad time."""
    at = F.col(created_at) if isinstance(created_at, str) else created_at
    then = F.try_to_timestamp(F.nullif(F.trim(at.cast("string")), F.lit("")))
    return (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(then)) / (DAY * 1_000_000)


def expired_leases(leases: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Leases at least ``days`` old, with ``age_days``; unknown ages are left alone."""
    if days < 1:
        raise ValueError("days must be at least 1")
    return leases.withColumn("age_days", age_days("created_at", now)).where(F.col("age_days") >= days)


#: Leases of a purge for each task; more make more tasks, not larger ones.
PURGE_LEASES = 500_000


def purge(drop: DataFrame, records: DataFrame, artifacts: dict[str, DataFrame], failures: DataFrame | None = None, actor: str = "retention") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the purge, one report row a lease).

    ``failures`` (lease_id, step, error) names steps that failed: that lease keeps
    that artifact and its record.  Artifacts are counted by lease before they meet
    the leases, in as many parts as the records ask for.
    """
    ids = drop.select("lease_id", "age_days").dropDuplicates(["lease_id"])
    parts = -(-records.count() // PURGE_LEASES)
    ids = ids.repartition(parts, "lease_id") if parts > 1 else ids
    errors = failures.groupBy("lease_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "step", "error"))).alias("errors")) if failures is not None else None
    report, left = ids, {}
    for name, rows in artifacts.items():
        gone = ids.select("lease_id")
        if failures is not None:
            gone = gone.join(failures.where(F.col("step") == name).select("lease_id"), "lease_id", "left_anti")
        left[name] = rows.join(gone, "lease_id", "left_anti")
        counts = rows.groupBy("lease_id").agg(F.count("*").alias(f"n_{name}"))
        if failures is not None:
            counts = counts.join(gone, "lease_id", "left_semi")
        report = report.join(counts, "lease_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    report = report.join(errors, "lease_id", "left") if errors is not None else report.withColumn("errors", F.lit(None).cast("array<string>"))
    report = report.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>"))).withColumn("succeeded", F.size("errors") == 0).withColumn("actor", F.lit(actor))
    left["records"] = records.join(report.where("succeeded").select("lease_id"), "lease_id", "left_anti")
    return left, report


def purge_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("eligible"), F.count_if("succeeded").alias("succeeded"))


def cap_history(comparisons: DataFrame, most: int = 500) -> DataFrame:
    """The newest ``most`` comparisons."""
    return comparisons.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def log_comparisons(history: DataFrame, new: DataFrame, most: int = 500) -> DataFrame:
    """The history with new comparisons (id, ..., created_at), of which the newest ``most`` stay."""
    return cap_history(history.unionByName(new), most)


def history_page(history: DataFrame, page: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """(a page of comparisons, newest first, their number)."""
    return page_rows(history, [F.col("created_at").desc(), F.col("id").desc()], page, size)
