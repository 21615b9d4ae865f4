"""Context, model answers and answer tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausemill.functions.redaction import redact_pii, sanitize_chunk
from clausemill.functions.text import squeezed, strip

from .vector_search import similar_pairs

#: Labels of an answer (fixed values).
SIGNALS = ("standard", "tenant_friendly", "landlord_friendly", "unusual", "red_flag")
REFUSAL = "I could not find this in the document."
INVALID = "The answer could not be read."
SIMILAR = 0.92
ANSWER = "answer string, quote string, signal string"


def _in_order(df: DataFrame, column: Column) -> Column:
    """Values of the (bounded) hits of a query by rank."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", column.alias("v")))), lambda x: x["v"])


def build_context(hits: DataFrame, most: int = 2000) -> DataFrame:
    """(query_id, context): blocks of a source line and the sanitised text, in rank order."""
    head = F.concat(F.lit("Source: "), F.coalesce("source", F.lit("unknown")), F.lit(", page "), F.coalesce(F.col("page").cast("string"), F.lit("N/A")))
    block = F.concat(head, F.lit("\n"), sanitize_chunk("text", most))
    return hits.groupBy("query_id").agg(F.concat_ws("\n\n", _in_order(hits, block)).alias("context"))


def source_references(hits: DataFrame, most: int = 500, ascii: bool = False) -> DataFrame:
    """(query_id, sources): clause id, type, excerpt cut and then redacted, source and page, by rank; ``ascii`` as in ``redact_pii``."""
    one = F.struct(F.col("chunk_id").alias("clause_id"), F.coalesce("clause_type", F.lit("other")).alias("clause_type"), redact_pii(F.substring("text", 1, most), ascii=ascii).alias("excerpt"), "source", "page")
    return hits.groupBy("query_id").agg(_in_order(hits, one).alias("sources"))


def unfenced(raw: Column | str) -> Column:
    """Content of one outer code fence, or the text itself, stripped."""
    raw = strip(F.col(raw) if isinstance(raw, str) else raw)
    inner = F.regexp_extract(raw, r"(?is)\A```[a-z]*[ \t]*\n?(.*?)\n?[ \t]*```\z", 1)
    return F.when(raw.rlike(r"(?is)\A```.*```\z"), strip(inner)).otherwise(raw)


def json_object(raw: Column | str) -> Column:
    """The text of a JSON object, bare or fenced; null for anything else."""
    text = unfenced(raw)
    value = F.try_parse_json(text)
    return F.when(value.isNotNull() & F.schema_of_variant(value).startswith("OBJECT"), text)


def parse_model_json(raw: Column | str, schema: str = ANSWER) -> Column:
    """A struct of the object's fields, null on failure."""
    text = json_object(raw)
    return F.when(text.isNotNull(), F.from_json(text, schema))


def validate_answer(raw: Column | str, signals: tuple[str, ...] = SIGNALS) -> Column:
    """The answer struct if answer, quote and signal are strings and the signal is known, else null."""
    value = F.try_parse_json(json_object(raw))
    typed = reduce(lambda a, b: a & b, (F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.lit(False)) for k in ("answer", "quote", "signal")))
    answer = parse_model_json(raw)
    return F.when(typed & answer["signal"].isin(*signals), answer)


def check_grounding(context: Column | str, quote: Column | str) -> Column:
    """Whether the quote occurs in the context, white space made single; an empty quote does not."""
    c, q = (squeezed(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))) for x in (context, quote))
    return (q != "") & c.contains(q)


def grounding_verdicts(raw: Column | str) -> Column:
    """(grounded, findings) of a judge's JSON; unreadable means not grounded."""
    text = json_object(raw)
    one = F.from_json(text, "grounded boolean, findings array<string>")
    known = text.isNotNull() & one["grounded"].isNotNull()
    return F.when(known, F.struct(one["grounded"].alias("grounded"), F.coalesce(one["findings"], F.array().cast("array<string>")).alias("findings"))).otherwise(
        F.struct(F.lit(False).alias("grounded"), F.array(F.lit("judge_unavailable")).alias("findings"))
    )


def resolve_answer(rows: DataFrame, guard: bool = True) -> DataFrame:
    """Final answer of (query_id, refused, confidence, sources, raw, grounded) rows.

    Gate refusal, then unreadable answer, then failed grounding, then the redacted
    answer.  An empty quote is none.
    """
    a = validate_answer("raw")
    rows = rows.withColumn("_a", a)
    failed = F.lit(guard) & ~F.coalesce("grounded", F.lit(False))
    outcome = F.when(F.col("refused"), "refused").when(F.col("_a").isNull(), "invalid").when(failed, "ungrounded").otherwise("answered")
    rows = rows.withColumn("outcome", outcome)
    given = F.col("outcome") == "answered"
    text = F.when(F.col("outcome") == "invalid", INVALID).when(given, redact_pii(F.col("_a.answer"))).otherwise(REFUSAL)
    return rows.select(
        "query_id",
        "outcome",
        text.alias("answer"),
        F.when(~F.col("refused"), F.col("sources")).alias("sources"),
        F.when(F.col("refused"), 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(given, F.nullif(redact_pii(F.col("_a.quote")), F.lit(""))).alias("quote"),
        F.when(given, F.col("_a.signal")).alias("signal"),
    )


def cache_key(lease: Column | str, question: Column | str, flags: Column | str) -> Column:
    """SHA-256 of lease, normalised question and configuration flags."""
    lease, question, flags = (F.col(x) if isinstance(x, str) else x for x in (lease, question, flags))
    normal = F.lower(squeezed(question))
    return F.sha2(F.concat_ws("\u001f", lease, normal, flags), 256)


def exact_answer_lookup(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with the stored response of the same key and lease, null without one."""
    return requests.join(answers.select("cache_key", "lease_id", "response"), ["cache_key", "lease_id"], "left")


def semantic_answer_lookup(requests: DataFrame, answers: DataFrame, least: float = SIMILAR, itself: bool = True) -> DataFrame:
    """(request_id, answer_id, similarity): the most similar answer of the same lease and flags, first on a tie.

    Bounds on angles leave few answers to compare with a request (``similar_pairs``);
    each task sends on only its best answer of a request.
    """
    near = similar_pairs(requests, answers, least, ["lease_id", "flags"], itself)
    w = Window.partitionBy("request_id").orderBy(F.round("similarity", 9).desc(), "answer_id")
    return near.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def evict_answers(answers: DataFrame, leases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers that stay, evicted counts by lease)."""
    gone = leases.select("lease_id").distinct()
    return answers.join(gone, "lease_id", "left_anti"), answers.join(gone, "lease_id", "left_semi").groupBy("lease_id").agg(F.count("*").alias("evicted"))


def cap_answers(answers: DataFrame, most: int, key: str = "answer_id") -> DataFrame:
    """The ``most`` answers used last, ties to the smaller key; a distributed top-n, no single-task window."""
    return answers.orderBy(F.col("last_used").desc(), F.col(key)).limit(most)


def cache_hits(requests: DataFrame, ingests: DataFrame) -> DataFrame:
    """(request_id, lease_id, cache_key, epoch, hit): whether the key was asked before since the lease's latest ingest.

    The epoch is the number of a lease's ingests so far.  It is the sum over earlier
    days, one row a day in the lease's window, and the running count within the
    day, so no window holds the whole log of a lease.
    """
    log = requests.select("request_id", "lease_id", "cache_key", "ts", F.lit(0).alias("ingest"))
    marks = ingests.select(F.lit(None).cast("long").alias("request_id"), "lease_id", F.lit(None).cast("string").alias("cache_key"), "ts", F.lit(1).alias("ingest"))
    rows = log.unionByName(marks).withColumn("day", F.to_date("ts"))
    earlier = Window.partitionBy("lease_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("lease_id", "day").agg(F.sum("ingest").alias("n")).select("lease_id", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("lease_id", "day").orderBy("ts", F.col("ingest").desc(), "request_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("so_far", F.sum("ingest").over(within)).where("ingest = 0").join(days, ["lease_id", "day"])
    rows = rows.select("request_id", "lease_id", "cache_key", "ts", (F.col("before") + F.col("so_far")).alias("epoch"))
    key = ["lease_id", "cache_key", "epoch"]
    first = rows.groupBy(*key).agg(F.min(F.struct("ts", "request_id"))["request_id"].alias("first"))
    return rows.join(first, key).select("request_id", *key, (F.col("request_id") != F.col("first")).alias("hit"))
