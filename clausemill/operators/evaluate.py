"""Retrieval metrics, judge verdicts, audits and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import json_object

K = 5
DIMENSIONS = ("faithfulness", "correctness", "relevance")
FLOORS = {"recall": 0.70, "precision": 0.10, "mrr": 0.55, "refusal_accuracy": 0.80, "faithfulness": 0.60, "correctness": 0.60, "relevance": 0.60}
#: Metrics that the gate tracks.
GATED = ("mrr", "recall", "precision", "refusal_accuracy", "answer_quality")


def question_scores(questions: DataFrame, relevant: DataFrame, hits: DataFrame, k: int = K) -> DataFrame:
    """Reciprocal rank, recall and precision at k of every question.

    ``questions`` (query_id, ...), ``relevant`` (query_id, chunk_id) and ``hits``
    (query_id, chunk_id, rank).  Where questions and hits have a ``config``, each
    configuration is scored for itself, all in one pass.  Ids that come twice count
    once; precision divides by what was retrieved within k.
    """
    key = ["config", "query_id"] if "config" in questions.columns else ["query_id"]
    wanted = relevant.select("query_id", "chunk_id").distinct()
    n_relevant = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    seen = hits.join(wanted.withColumn("good", F.lit(True)), ["query_id", "chunk_id"], "left")
    per = seen.groupBy(*key).agg(
        F.min(F.when(F.col("good"), F.col("rank"))).alias("first"),
        F.count_distinct(F.when(F.col("good") & (F.col("rank") <= k), F.col("chunk_id"))).alias("found"),
        F.count_if(F.col("rank") <= k).alias("retrieved"),
    )
    rows = questions.join(n_relevant, "query_id", "left").join(per, key, "left")
    found = F.coalesce("found", F.lit(0))
    return rows.select(
        *questions.columns,
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.when(F.col("n_relevant") > 0, found / F.col("n_relevant")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.when(F.col("retrieved") > 0, found / F.col("retrieved")), F.lit(0.0)).alias("precision"),
    )


def refusal_accuracy(should: str = "should_refuse", did: str = "refused") -> Column:
    """Aggregate: share of questions refused as they should be; 0 without any."""
    return F.coalesce(F.avg(F.col(should).eqNullSafe(F.col(did)).cast("int")), F.lit(0.0))


def retrieval_report(scores: DataFrame) -> DataFrame:
    """Metrics of each config and of each of its categories; category ``overall`` for all."""
    rows = scores.groupingSets([["config", "category"], ["config"]], "config", "category").agg(
        F.grouping("category").alias("g"), F.count("*").alias("n"), F.avg("rr").alias("mrr"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), refusal_accuracy().alias("refusal_accuracy")
    )
    return rows.withColumn("category", F.when(F.col("g") == 1, "overall").otherwise(F.col("category"))).drop("g")


def compare_configs(report: DataFrame, configs: list[str]) -> DataFrame:
    """One row a metric of the overall rows, one column a config."""
    overall = report.where("category = 'overall'").select("config", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mrr", "recall", "precision", "refusal_accuracy")))))
    return overall.groupBy("metric").pivot("config", configs).agg(F.first("value"))


def parse_verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The three dimensions of judge JSON, 0 unless a number in 0..1, and ``unavailable`` for bad JSON."""
    text = json_object(raw)
    out = df.withColumn("_v", F.try_parse_json(text))

    def dimension(name: str) -> Column:
        value = F.try_variant_get("_v", f"$.{name}", "variant")
        number = F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get("_v", f"$.{name}", "double"))
        return F.when(number.between(0, 1), number).otherwise(0.0).alias(name)

    kept = [c for c in df.columns if c != raw]
    return out.select(*kept, *(dimension(d) for d in DIMENSIONS), F.col("_v").isNull().alias("unavailable"))


def answer_quality(verdicts: DataFrame) -> DataFrame:
    """One row: mean of each dimension and of their mean, over available verdicts of questions to be answered."""
    use = ~F.col("unavailable") & ~F.coalesce("should_refuse", F.lit(False))
    means = [F.coalesce(F.avg(F.when(use, F.col(d))), F.lit(0.0)).alias(d) for d in DIMENSIONS]
    mean = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0])) / len(DIMENSIONS)
    return verdicts.agg(
        *means, F.coalesce(F.avg(F.when(use, mean)), F.lit(0.0)).alias("answer_quality"), F.count_if(use).alias("judged"),
        F.count_if(F.col("unavailable") & ~F.coalesce("should_refuse", F.lit(False))).alias("unavailable"), (F.count_if(use) == 0).alias("none_available"),
    )


def regression_check(current: DataFrame, baseline: DataFrame, threshold: float = 5.0) -> DataFrame:
    """(metric, current, prior, pct, status) of two (metric, value) tables."""
    rows = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("prior")), "metric", "full_outer")
    pct = F.when(F.col("prior") == 0, 0.0).otherwise((F.col("current") - F.col("prior")) / F.col("prior") * 100)
    rows = rows.withColumn("pct", pct)
    status = F.when(F.col("pct").isNull(), "MISSING").when(F.col("pct") <= -threshold, "REGRESSION").when(F.col("pct") <= -threshold / 2, "WARN").otherwise("OK")
    return rows.withColumn("status", status)


def tracked_check(current: DataFrame, baseline: DataFrame, threshold: float = 5.0, tracked: tuple[str, ...] = GATED) -> DataFrame:
    """``regression_check`` of the metrics that the gate tracks; others never fail a run."""
    return regression_check(current.where(F.col("metric").isin(*tracked)), baseline.where(F.col("metric").isin(*tracked)), threshold)


def quality_floors(metrics: DataFrame, floors: dict[str, float] = FLOORS) -> DataFrame:
    """(metric, value, floor) of metrics under their floor."""
    table = F.create_map(*(F.lit(x) for kv in floors.items() for x in kv))
    return metrics.withColumn("floor", table[F.col("metric")]).where("value < floor").select("metric", "value", "floor")


def _said(value: Column) -> Column:
    """A JSON value as text: null, true and false by their Python names, no value as ``unknown``, objects and arrays as JSON."""
    kind = F.schema_of_variant(value)
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    return F.when(value.isNull(), "unknown").when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: all but nothing, null, false, zero and what is empty."""
    kind, text = F.schema_of_variant(value), F.to_json(value)
    number = F.try_variant_get(value, "$", "double")
    yes = F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != '""').when(text.rlike(r"^[\[{]"), ~text.isin("[]", "{}")).when(kind != "VOID", number != 0)
    return F.coalesce(yes, F.lit(False))


def audit_verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """has_pii and findings (category, location) of audit JSON; unreadable counts as a finding.

    A missing flag is false.  Of the findings the objects count, their values as text.
    """
    rows = df.withColumn("_a", F.try_parse_json(json_object(raw)))
    bad = F.col("_a").isNull()
    failed = F.array(F.struct(F.lit("audit_unavailable").alias("category"), F.lit("unknown").alias("location")))
    items = F.filter(F.try_variant_get("_a", "$.findings", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    said = F.transform(items, lambda x: F.struct(*(_said(F.try_variant_get(x, f"$.{f}", "variant")).alias(f) for f in ("category", "location"))))
    clean = F.coalesce(said, F.array().cast("array<struct<category:string,location:string>>"))
    kept = [c for c in df.columns if c != raw]
    return rows.select(*kept, F.when(bad, True).otherwise(_truthy(F.try_variant_get("_a", "$.has_pii", "variant"))).alias("has_pii"), F.when(bad, failed).otherwise(clean).alias("findings"))


def audit_scorecard(fixtures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: passed, failed, total of audits joined by ``fixture_id``."""
    expects = (F.size("expected_regex_categories") > 0) | (F.size("expected_llm_categories") > 0)
    ok = F.when(expects, F.col("has_pii")).otherwise(~F.col("has_pii") | (F.size("findings") == 0))
    rows = fixtures.join(verdicts, "fixture_id").select(F.coalesce(ok, F.lit(False)).alias("ok"))
    return rows.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))


def redaction_recall(fixtures: DataFrame, ascii: bool = False) -> DataFrame:
    """Adds ``complete``: the token of every expected category is there after redaction; ``ascii`` as in ``redact_pii``."""
    from clausemill.functions.redaction import redact_pii

    rows = fixtures.withColumn("redacted", redact_pii("payload", ascii=ascii))
    return rows.withColumn("complete", F.forall("expected_regex_categories", lambda c: F.col("redacted").contains(F.concat(F.lit("[REDACTED_"), F.upper(c), F.lit("]")))))
