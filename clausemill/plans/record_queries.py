"""Queries over answers, leases, comparison, evaluation and request logs, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.redaction import PII_RULES
from clausemill.operators import answers, compare, evaluate, leases, requests, retrieval

from clausemill.sources.tables import saved

from .bindings import table
from .bindings import requests as request_log
from .chunk_queries import masked
from .retrieval_queries import ALL_MODES, COSINE, DENSE, hashed, modes, stored_index

NOW = "2001-08-02 00:00:00"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dense neighbours of each asking vector, with document texts standing in for chunk texts."""
    from .bindings import vectors

    hits = saved(retrieval.dense_topk(*vectors(spark, sf_dir)), "hits")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", "source", F.col("lang").alias("clause_type"), F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") + 1).alias("page"))
    return hits.join(retrieval.chunks_of(hits, docs), "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def e1_build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.build_context(_hits(spark, sf_dir)).select("query_id", F.md5("context").alias("digest"))


def e2_source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.source_references(_hits(spark, sf_dir), ascii=True)
    return rows.select("query_id", F.posexplode("sources").alias("i", "s")).select("query_id", "i", "s.clause_id", "s.clause_type", F.md5("s.excerpt").alias("digest"), "s.source", "s.page")


def e3_parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```JSON\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", answers.parse_model_json(raw, "k bigint")["k"].alias("k"))


def _holding(spark: SparkSession, sf_dir: str, holds) -> DataFrame:
    """(item_id, doc_id): documents that hold an item's text by ``holds(text, item)``.

    A text that holds an item has all tokens that lie inside the item, so the
    postings of its rarest one name all that can hold it; texts are fetched for
    those alone.  Items of under three tokens have none inside and are compared with
    every text, as a filter on the scan.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = stored_index(spark, sf_dir)
    inner = items.withColumn("t", retrieval.tokens("item")).where(F.size("t") > 2)
    inner = inner.select("item_id", F.explode(F.slice("t", F.lit(2), F.size("t") - 2)).alias("term")).distinct()
    known = index.idf.join(retrieval.bounded(inner.select("term").distinct()), "term", "left_semi").select("term", "idf")
    # a term that no text has is the rarest
    rarest = inner.join(known, "term", "left").groupBy("item_id").agg(F.max_by("term", F.coalesce("idf", F.lit(float("inf")))).alias("term"))
    pairs = saved(index.tf.select("term", F.col("chunk_id").alias("doc_id")).join(retrieval.bounded(rarest), "term").select("item_id", "doc_id"), "pairs")
    found = docs.join(retrieval.bounded(pairs), "doc_id").join(retrieval.bounded(items), "item_id").where(holds("text", "item")).select("item_id", "doc_id")
    short = items.where(F.size(retrieval.tokens("item")) <= 2)
    if short.limit(1).count():
        found = found.unionByName(docs.join(retrieval.bounded(short), holds("text", "item")).select("item_id", "doc_id"))
    return found


def e6_check_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which an item's text occurs as a quote, by item."""
    found = _holding(spark, sf_dir, answers.check_grounding).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    rows = table(spark, sf_dir, "benchmark").select("item_id").join(found, "item_id", "left")
    return rows.select("item_id", F.col("n").isNotNull().alias("grounded"), F.coalesce("n", F.lit(0)).alias("n_docs"), "first")


def e7_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", answers.cache_key(F.col("conv_id").cast("string"), F.col("text"), F.lit("k=5;a=0.5")).alias("cache_key"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("lease_id"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("cache_key"), "ts", "value")


def e8_exact_answer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    stored = log.where("value > 100").groupBy("cache_key", "lease_id").agg(F.max("request_id").cast("string").alias("response"))
    return answers.exact_answer_lookup(log.select("request_id", "cache_key", "lease_id"), stored).select("request_id", "response")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, answers): every vector is an answer; every twentieth asks for its successor, moved more or less toward the one after that."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("lease_id"), (F.col("vec_id") % 2).cast("string").alias("flags"), "embedding")
    asks = rows.where("id % 20 = 0").select(F.col("id").alias("request_id"))
    near = rows.select((F.col("id") - 1).alias("request_id"), "lease_id", "flags", F.col("embedding").alias("a"))
    far = rows.select((F.col("id") - 2).alias("request_id"), F.col("embedding").alias("b"))
    asks = asks.join(near, "request_id").join(far, "request_id", "left")
    weight = 0.2 + 0.05 * (F.floor(F.col("request_id") / 20) % 10)
    moved = F.zip_with("a", F.coalesce("b", "a"), lambda x, y: x.cast("double") + F.col("weight") * y.cast("double"))
    return asks.withColumn("weight", weight).select("request_id", "lease_id", "flags", moved.alias("embedding")), rows.withColumnRenamed("id", "answer_id")


def e9_semantic_answer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other answer of every asking vector, if it is near enough."""
    rows = answers.semantic_answer_lookup(*_answers(spark, sf_dir), itself=False)
    return rows.select("request_id", "answer_id", F.round("similarity", 6).alias("similarity"))


def e10_evict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("lease_id"))
    gone = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("lease_id"))
    return answers.evict_answers(stored, gone)[1]


def e11_cap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.col("o_orderdate").alias("last_used"))
    return answers.cap_answers(rows, 256)


def e12_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return answers.cache_hits(log.where("request_id % 97 <> 0"), log.where("request_id % 97 = 0")).select("request_id", "epoch", "hit")


def _leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(
        F.col("c_custkey").alias("lease_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tenant"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey").cast("string")).alias("landlord"),
        F.when(F.col("c_custkey") % 5 > 0, "1999-01-01").otherwise("Unknown").alias("start_date"), F.when(F.col("c_custkey") % 7 > 0, "2000-01-01").alias("end_date"),
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).otherwise("").alias("rent_amount"), F.lit(None).cast("string").alias("location"),
    )


def f1_select_metadata_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("lease_id"), F.col("doc_id").alias("chunk_no"), "text")
    return leases.select_metadata_chunks(docs, signals=("[0-9]{4}", "shand|ndthe", "que la|das"))


SIGNAL_LINES = ("Tenant Signature ______", "approved  occupants: none", "Name: A", "MONTHLY RENT", "commencing on", "expires", "Lease Term", "property address", "the lessee", "Landlord", "nothing of that kind", "signed by nobody")


def f1_default_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice by the default signals, over texts of which every third gets a line with one."""
    line = F.get(F.array(*map(F.lit, SIGNAL_LINES)), (F.floor(F.col("doc_id") / 3) % len(SIGNAL_LINES)).cast("int"))
    text = F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") > 20), F.concat_ws("\n", "text", line)).otherwise(F.col("text"))
    return leases.select_metadata_chunks(table(spark, sf_dir, "documents").select(F.col("source").alias("lease_id"), F.col("doc_id").alias("chunk_no"), text.alias("text")))


def f3_merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _leases(spark, sf_dir)
    patch = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("lease_id"), F.lit("Unknown").alias("tenant"), F.col("s_name").alias("landlord"), F.lit("2001-05-05").alias("start_date"), F.lit(" ").alias("end_date"),
        F.when(F.col("s_acctbal") > 0, "900").alias("rent_amount"), F.col("s_nationkey").cast("string").alias("location"),
    )
    full = leases.merge_metadata(base, patch).select("lease_id", F.lit("update").alias("mode"), *leases.FIELDS, F.concat_ws(",", "changed").alias("changed"))
    return full.unionByName(leases.merge_metadata(base, patch, True).select("lease_id", F.lit("missing").alias("mode"), *leases.FIELDS, F.concat_ws(",", "changed").alias("changed")))


def f4_register_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lease_id"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("rent"), F.struct("o_orderdate", "o_orderkey").alias("written"))
    return leases.register_leases(rows).select("lease_id", "name", "rent", F.col("written.o_orderkey").alias("row"))


def f4_list_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the registered leases, newest first, and some leases by their ids, one of which is unknown."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lease_id"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").alias("created_at"), F.struct("o_orderdate", "o_orderkey").alias("written"))
    known = saved(leases.register_leases(rows).drop("written"), "leases")
    page, total = leases.list_leases(known, 2, 30)
    wanted = table(spark, sf_dir, "customer").where("c_custkey % 50 = 1").select(F.col("c_custkey").alias("lease_id"))
    found = leases.get_leases(known, wanted.unionByName(wanted.limit(0).unionByName(spark.range(1).select(F.lit(-1).cast(wanted.schema["lease_id"].dataType).alias("lease_id")))))
    return page.withColumn("kind", F.lit("page")).unionByName(found.withColumn("kind", F.lit("get"))).withColumn("total", F.lit(total).cast("long"))


def f5_lease_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leases(spark, sf_dir).select("lease_id", leases.lease_status().alias("status"))


def f6_portfolio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return leases.portfolio_stats(_leases(spark, sf_dir), leases.cap_history(pairs, 500))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lease_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


def f7_recent_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.recent_leases(_orders(spark, sf_dir), "2001-08-02", 200).select("lease_id", "created_at", "age")


def f8_search_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.search_leases(_leases(spark, sf_dir), " 99 ").unionByName(leases.search_leases(_leases(spark, sf_dir), "house")).select("lease_id", "name", "tenant")


def f9_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _leases(spark, sf_dir).select("lease_id", "name")
    a, total = leases.page_rows(base, [F.col("name")], 3, 20)
    b, _ = leases.page_rows(base, [F.col("name")], 10**6, 10, clamp=True, shallow=50)
    return a.withColumn("page", F.lit("3")).unionByName(b.withColumn("page", F.lit("last"))).withColumn("total", F.lit(total).cast("long"))


def f10_age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("lease_id") % 11 == 0, "junk").when(F.col("lease_id") % 13 == 0, "").otherwise(F.col("created_at"))
    return _orders(spark, sf_dir).select("lease_id", F.round(leases.age_days(at, NOW), 6).alias("age_days"))


def f11_expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.expired_leases(_orders(spark, sf_dir), NOW, 365).select("lease_id", F.round("age_days", 6).alias("age_days"))


def _purged(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    orders = _orders(spark, sf_dir)
    drop = leases.expired_leases(orders, NOW, 2160)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lease_id"), "l_linenumber")
    return leases.purge(drop, orders, {"chunks": items, "answers": items.where("l_linenumber = 1")})


def f12_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _purged(spark, sf_dir)[1].select("lease_id", F.round("age_days", 6).alias("age_days"), "n_chunks", "n_answers", "succeeded", "actor")


def f13_purge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, report = _purged(spark, sf_dir)
    return leases.purge_summary(report).crossJoin(left["records"].agg(F.count("*").alias("records_left")))  # one row each


def f14_cap_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of what is kept after the comparisons of even ids are logged."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    history = saved(leases.log_comparisons(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), 500), "history")
    page, total = leases.history_page(history, 3, 20)
    kept = history.withColumn("page", F.lit("all")).unionByName(page.withColumn("page", F.lit("3")))
    return kept.withColumn("total", F.lit(total).cast("long"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("lease_id"), F.col("doc_id").alias("chunk_no"), F.when(F.col("doc_id") % 17 > 0, F.concat_ws("-", "lang", (F.length("text") % 8).cast("string"))).alias("clause_type"), "text")
    return compare.group_clauses(docs)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pair_id"), F.concat(F.lit("src"), F.col("n_nationkey")).alias("left_id"), F.concat(F.lit("src"), (F.col("n_nationkey") * 3 + 1) % 23).alias("right_id"))
    return ids.where("left_id <> right_id")


def f15_group_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("lease_id", "clause_type", "chunk_no", "n")


def f16_clause_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.clause_overlap(_pairs(spark, sf_dir), _groups(spark, sf_dir))


def f17_one_sided_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.one_sided_diffs(_pairs(spark, sf_dir), _groups(spark, sf_dir), ascii=True)
    return rows.select("pair_id", "clause_type", F.md5("left_value").alias("l"), F.md5("right_value").alias("r"), "difference", "insight")


def f18_shared_clause_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.shared_clause_pairs(_pairs(spark, sf_dir), _groups(spark, sf_dir))
    return rows.select("pair_id", "clause_type", F.md5("left_text").alias("l"), F.md5("right_text").alias("r"))


def f19_shared_clause_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare.shared_clause_delta(compare.shared_clause_pairs(_pairs(spark, sf_dir), _groups(spark, sf_dir)))
    return rows.select("pair_id", "clause_type", F.round("jaccard", 6).alias("jaccard"), F.md5(F.concat_ws(" ", "left_tokens")).alias("l"), F.md5(F.concat_ws(" ", "right_tokens")).alias("r"), F.concat_ws(" ", "left_amounts").alias("la"), F.concat_ws(" ", "right_amounts").alias("ra"))


def f21_missing_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("lease_id"), "lang")
    return compare.missing_leases(_pairs(spark, sf_dir), docs, docs.where("lease_id <> 'src4'"))


CONFIGS = ("dense", "dense+rerank", "hybrid", "hybrid+rerank")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all questions under the four configurations, by the natural golden set."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    relevant = saved(_holding(spark, sf_dir, lambda text, item: F.col(text).contains(F.col(item))).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id")), "relevant")
    golden = asked.join(relevant.select("query_id").distinct().withColumn("known", F.lit(True)), "query_id", "left")
    golden = saved(golden.select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.col("known").isNull().alias("should_refuse")), "golden")
    hits = saved(modes(spark, sf_dir, CONFIGS), "hits")
    each = golden.withColumn("config", F.explode(F.array(*map(F.lit, CONFIGS))))
    return evaluate.question_scores(each, relevant, hits).join(retrieval.refusal_gate(each, hits).select("config", "query_id", "refused"), ["config", "query_id"])


def g1_question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("config", "query_id", "should_refuse", "refused", *(F.round(c, 6).alias(c) for c in ("rr", "recall", "precision")))


def g5_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.retrieval_report(_evaluated(spark, sf_dir))
    return rows.select("config", "category", "n", *(F.round(c, 6).alias(c) for c in ("mrr", "recall", "precision", "refusal_accuracy")))


def g6_compare_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.compare_configs(evaluate.retrieval_report(_evaluated(spark, sf_dir)), list(CONFIGS))
    return rows.select("metric", *(F.round(f"`{c}`", 6).alias(c.replace("+", "_")) for c in CONFIGS))


def g8_answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("faithfulness"), F.col("l_tax").alias("correctness"), (F.col("l_quantity") / 100).alias("relevance"), (F.col("l_returnflag") == "R").alias("unavailable"), (F.col("l_linestatus") == "F").alias("should_refuse"))
    out = evaluate.answer_quality(rows)
    return out.select(*(F.round(c, 6).alias(c) for c in ("faithfulness", "correctness", "relevance", "answer_quality")), "judged", "unavailable", "none_available")


def _metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("metric")).agg(F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"))
    current = rows.where("metric <> 'Brand#1'").select("metric", F.round("a", 3).alias("value"))
    return current, rows.where("metric <> 'Brand#2'").select("metric", F.round(F.col("b") / 57, 3).alias("value"))


def g9_regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.regression_check(*_metrics(spark, sf_dir))
    return rows.select("metric", "current", "prior", F.round("pct", 6).alias("pct"), "status")


def g9_tracked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the five metrics that it tracks, of reports that hold others and categories too."""
    rows = table(spark, sf_dir, "part").where("p_size <= 50").groupBy((F.col("p_size") % 8).alias("k")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    names = F.get(F.array(*map(F.lit, (*evaluate.GATED, "latency", "recall_overall", "coverage"))), F.col("k").cast("int"))
    return evaluate.tracked_check(rows.select(names.alias("metric"), F.round("b", 3).alias("value")), rows.select(names.alias("metric"), F.round(F.col("a") / 57, 3).alias("value"))).select("metric", "current", "prior", F.round("pct", 6).alias("pct"), "status")


def g10_quality_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, _ = _metrics(spark, sf_dir)
    return evaluate.quality_floors(current, {f"Brand#{k}": 25.0 for k in range(1, 26)})


def h1_client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id"), F.lit(" , 10.1.1.1"))).alias("forwarded_for"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).otherwise(" ").alias("host"))
    return rows.select("request_id", requests.client_key().alias("client"))


def h2_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.rate_limit(request_log(spark, sf_dir), 3, 86_400)


def h3_over_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.over_limit_windows(request_log(spark, sf_dir), 3, 86_400).select("request_id", "in_window", "over")


def h4_count_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.count_outcomes(request_log(spark, sf_dir), "status")


def h5_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.latency_histogram(request_log(spark, sf_dir), "status")
    return rows.select("status", "le", "n", F.round("total_ms", 2).alias("total_ms"))


def h6_latency_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.latency_quantile(requests.latency_histogram(request_log(spark, sf_dir), "status"), "status")
    return rows.select("status", F.round("quantile_ms", 6).alias("quantile_ms"))


def h6_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantile of all days by status from the days' stored sketches, and whether its rank is as near as the sketch promises, for tie-free shares too."""
    log = request_log(spark, sf_dir)
    days = saved(requests.latency_sketches(log, "status"), "sketches")
    found = saved(requests.merged_quantile(days, "status"), "quantiles")
    ranks = log.join(F.broadcast(found.select("status", "quantile_ms")), "status").groupBy("status").agg(F.avg((F.col("latency_ms") < F.col("quantile_ms")).cast("int")).alias("below"), F.avg((F.col("latency_ms") <= F.col("quantile_ms")).cast("int")).alias("upto"))
    near = (F.col("below") <= 0.95 + 2 * requests.RANK_ERROR) & (F.col("upto") >= 0.95 - 2 * requests.RANK_ERROR)
    return found.join(ranks, "status").select("status", "n", near.alias("near"))


def h7_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as log rows, the question as its hash."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"))
    return requests.access_log(rows, "salt")


def h7_access_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir).withColumn("route", F.concat(F.lit("/r/"), F.col("client_key").cast("int") % 10))
    return requests.access_rollup(rows).select("route", "status", "n", F.round("mean_ms", 6).alias("mean_ms"))


def _chosen(docs: str, signals: tuple[str, ...]) -> str:
    """The choice of metadata chunks by three signals."""
    flags = ", ".join(f"regexp_matches(text, '{p}') AS s{k}" for k, p in enumerate(signals))
    keys = " UNION ALL ".join(f"SELECT lease_id, {k} AS p, no AS i, {o} AS o, no + {o} AS no FROM c WHERE s{k}" for o in (0, 1) for k in range(3))
    return f"""WITH c AS (SELECT source AS lease_id, doc_id AS chunk_no, row_number() OVER w AS no, {flags} FROM {docs} WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
k AS ({keys}),
b AS (SELECT lease_id, no, min((p, i, o)) AS key FROM k WHERE no > 5 GROUP BY ALL),
x AS (SELECT c.lease_id, c.chunk_no FROM b JOIN c USING (lease_id, no) QUALIFY row_number() OVER (PARTITION BY c.lease_id ORDER BY key, c.chunk_no) <= 7)
SELECT lease_id, chunk_no, 'first' AS chosen FROM c WHERE no <= 5 UNION ALL SELECT lease_id, chunk_no, 'signal' FROM x"""


_HITS = f"""{DENSE}, hits AS (
  SELECT r.query_id, r.rank, r.chunk_id, coalesce(d.text, '') AS text, d.source, d.lang AS clause_type, CASE WHEN d.doc_id % 9 > 0 THEN d.doc_id + 1 END AS page
  FROM ranked r LEFT JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 5)"""
_LOG = "log AS (SELECT event_id AS request_id, event_type AS lease_id, event_type || '-' || user_id AS cache_key, ts, value FROM events)"
_LEASES = """leases AS (SELECT c_custkey AS lease_id, c_name AS name, c_mktsegment AS tenant, CASE WHEN c_nationkey > 2 THEN c_nationkey::VARCHAR END AS landlord, CASE WHEN c_custkey % 5 > 0 THEN '1999-01-01' ELSE 'Unknown' END AS start_date,
  CASE WHEN c_custkey % 7 > 0 THEN '2000-01-01' END AS end_date, CASE WHEN c_acctbal > 0 THEN c_custkey::VARCHAR ELSE '' END AS rent_amount, NULL::VARCHAR AS location FROM customer)"""
_STATUS = "CASE WHEN start_date = 'Unknown' OR end_date IS NULL OR rent_amount = '' THEN 'pending' ELSE 'active' END"
_PATCH = "patch AS (SELECT s_suppkey AS lease_id, 'Unknown' AS tenant, s_name AS landlord, '2001-05-05' AS start_date, ' ' AS end_date, CASE WHEN s_acctbal > 0 THEN '900' END AS rent_amount, s_nationkey::VARCHAR AS location FROM supplier)"


def _merge(mode: str) -> str:
    unknown = "({c} IS NULL OR trim({c}) = '' OR {c} = 'Unknown')"
    takes = {f: (f"p.{f} IS NOT NULL AND p.{f} <> 'Unknown'" if mode == "update" else f"NOT {unknown.format(c='p.' + f)} AND {unknown.format(c='l.' + f)}") for f in leases.FIELDS}
    values = ", ".join(f"CASE WHEN {t} THEN p.{f} ELSE l.{f} END AS {f}" for f, t in takes.items())
    changed = ", ".join(f"CASE WHEN ({t}) AND l.{f} IS DISTINCT FROM p.{f} THEN '{f}' END" for f, t in takes.items())
    return f"SELECT l.lease_id, '{mode}' AS mode, {values}, array_to_string(list_filter([{changed}], lambda x: x IS NOT NULL), ',') AS changed FROM leases l LEFT JOIN patch p USING (lease_id)"


_AGE = "round(epoch(TIMESTAMP '2001-08-02' - o_orderdate) / 86400, 6)"
_GROUPS = """groups AS (SELECT source AS lease_id, coalesce(CASE WHEN doc_id % 17 > 0 THEN lang || '-' || (length(text) % 8) END, 'other') AS clause_type, doc_id AS chunk_no, text,
  row_number() OVER (PARTITION BY source, coalesce(CASE WHEN doc_id % 17 > 0 THEN lang || '-' || (length(text) % 8) END, 'other') ORDER BY doc_id)::INT AS n FROM documents QUALIFY n <= 20)"""
_SPARSE = f"""{_GROUPS}, sparse AS (SELECT * FROM groups),
pairs AS (SELECT * FROM (SELECT n_nationkey AS pair_id, 'src' || n_nationkey AS left_id, 'src' || ((n_nationkey * 3 + 1) % 23) AS right_id FROM nation) WHERE left_id <> right_id)"""
_JOINED = r"""joined AS (SELECT lease_id, clause_type, substring(string_agg(regexp_replace(substring(text, 1, 2000), '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY chunk_no), 1, 4000) AS t FROM sparse GROUP BY ALL),
shared AS (SELECT p.pair_id, l.clause_type, l.t AS lt, r.t AS rt FROM pairs p JOIN joined l ON l.lease_id = p.left_id JOIN joined r ON r.lease_id = p.right_id AND r.clause_type = l.clause_type)"""
_EVAL = f"""{ALL_MODES}, relevant AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
golden AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, item_id NOT IN (SELECT query_id FROM relevant) AS should_refuse FROM benchmark),
h AS (SELECT * FROM found WHERE config NOT LIKE 'lexical%'),
c AS (SELECT config, g.* FROM golden g, (SELECT DISTINCT config FROM h)),
e AS (SELECT c.config, c.query_id, c.category, c.should_refuse, coalesce(1 / min(CASE WHEN r.chunk_id IS NOT NULL THEN h.rank END), 0)::DOUBLE AS rr, count(DISTINCT r.chunk_id) AS found, count(h.rank) AS retrieved, min(h.distance) IS NULL OR min(h.distance) > 0.55 AS refused
  FROM c LEFT JOIN h ON h.config = c.config AND h.query_id = c.query_id LEFT JOIN relevant r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id GROUP BY ALL),
s AS (SELECT e.config, e.query_id, category, should_refuse, refused, rr, coalesce(found / nullif(n, 0), 0) AS recall, coalesce(found / nullif(retrieved, 0), 0) AS precision
  FROM e LEFT JOIN (SELECT query_id, count(*) AS n FROM relevant GROUP BY 1) USING (query_id)),
report AS (SELECT config, coalesce(category, 'overall') AS category, count(*) AS n, avg(rr) AS mrr, avg(recall) AS recall, avg(precision) AS precision, avg((should_refuse = refused)::INT) AS refusal_accuracy FROM s GROUP BY GROUPING SETS ((config, category), (config)))"""
_METRICS = "m AS (SELECT p_brand AS metric, avg(p_size) AS a, avg(p_retailprice) AS b FROM part GROUP BY 1), cur AS (SELECT metric, round(a, 3) AS value FROM m WHERE metric <> 'Brand#1'), base AS (SELECT metric, round(b / 57, 3) AS value FROM m WHERE metric <> 'Brand#2')"
REGRESSION = f"""WITH {_METRICS}, j AS (SELECT metric, cur.value AS current, base.value AS prior, CASE WHEN base.value = 0 THEN 0 ELSE (cur.value - base.value) / base.value * 100 END AS pct FROM cur FULL JOIN base USING (metric))
SELECT metric, current, prior, pct, CASE WHEN pct IS NULL THEN 'MISSING' WHEN pct <= -5 THEN 'REGRESSION' WHEN pct <= -2.5 THEN 'WARN' ELSE 'OK' END AS status FROM j"""
_HIST = "h AS (SELECT event_type AS status, le, ord, count(*) FILTER (value <= le_v) AS n, sum(value) AS total_ms, le_v FROM events, (SELECT unnest([10,25,50,100,250,500,1000,2500,5000,10000,1e300]) AS le_v, unnest(['10','25','50','100','250','500','1000','2500','5000','10000','+Inf']) AS le, unnest(range(11)) AS ord) GROUP BY ALL)"

#: Three accepted requests a day and client: of the last three accepted times the oldest decides.
LIMITED = """
WITH RECURSIVE e AS (SELECT event_id, user_id::VARCHAR AS client_key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT event_id, client_key, n, true AS allowed, NULL::BIGINT AS retry_after, ts AS a, NULL::TIMESTAMP AS b, NULL::TIMESTAMP AS c FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.client_key, e.n, f.ok, CASE WHEN NOT f.ok THEN greatest(1, floor(86400 - (epoch_us(e.ts) - epoch_us(r.c)) / 1e6)::BIGINT + 1) END,
    CASE WHEN f.ok THEN e.ts ELSE r.a END, CASE WHEN f.ok THEN r.a ELSE r.b END, CASE WHEN f.ok THEN r.b ELSE r.c END
  FROM r JOIN e ON e.client_key = r.client_key AND e.n = r.n + 1, LATERAL (SELECT r.c IS NULL OR r.c <= e.ts - INTERVAL 1 DAY AS ok) f
)
SELECT event_id AS request_id, client_key, allowed, retry_after FROM r"""

QUERIES = {
    f.__name__: f
    for f in (
        e1_build_context, e2_source_references, e3_parse_model_json, e6_check_grounding, e7_cache_key, e8_exact_answer_lookup, e9_semantic_answer_lookup, e10_evict_answers, e11_cap_answers, e12_cache_hits,
        f1_select_metadata_chunks, f1_default_signals, f3_merge_metadata, f4_register_leases, f4_list_leases, f5_lease_status, f6_portfolio_stats, f7_recent_leases, f8_search_leases, f9_page_rows, f10_age_days, f11_expired_leases, f12_purge, f13_purge_summary, f14_cap_history,
        f15_group_clauses, f16_clause_overlap, f17_one_sided_diffs, f18_shared_clause_pairs, f19_shared_clause_delta, f21_missing_leases, g1_question_scores, g5_retrieval_report, g6_compare_configs, g8_answer_quality, g9_regression_check, g9_tracked_metrics, g10_quality_floors,
        h1_client_key, h2_rate_limit, h3_over_limit_windows, h4_count_outcomes, h5_latency_histogram, h6_latency_quantile, h6_merged_sketches, h7_access_log, h7_access_rollup,
    )
}
ORACLES = {
    "e1_build_context": rf"""WITH {_HITS}, b AS (SELECT query_id, rank, 'Source: ' || coalesce(source, 'unknown') || ', page ' || coalesce(page::VARCHAR, 'N/A') || chr(10) || regexp_replace(substring(text, 1, 2000), '^\s+|\s+$', '', 'g') AS block FROM hits)
SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS digest FROM b GROUP BY 1""",
    "e2_source_references": f"WITH {_HITS} SELECT query_id, (rank - 1)::INT AS i, chunk_id AS clause_id, coalesce(clause_type, 'other') AS clause_type, md5({masked('substring(text, 1, 500)', PII_RULES)}) AS digest, source, page FROM hits",
    "e3_parse_model_json": "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN (props->>'k')::BIGINT END AS k FROM events",
    "e6_check_grounding": r"""WITH g AS (SELECT item_id, count(*) AS n, min(doc_id) AS first FROM documents d JOIN benchmark b ON contains(regexp_replace(d.text, '\s+', ' ', 'g'), trim(regexp_replace(b.text, '\s+', ' ', 'g'))) GROUP BY 1)
SELECT item_id, n IS NOT NULL AS grounded, coalesce(n, 0) AS n_docs, first FROM benchmark LEFT JOIN g USING (item_id)""",
    "e7_cache_key": r"SELECT conv_id, turn, sha256(conv_id || chr(31) || lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) || chr(31) || 'k=5;a=0.5') AS cache_key FROM conversations WHERE role = 'user'",
    "e8_exact_answer_lookup": f"WITH {_LOG} SELECT l.request_id, s.response FROM log l LEFT JOIN (SELECT cache_key, lease_id, max(request_id)::VARCHAR AS response FROM log WHERE value > 100 GROUP BY ALL) s USING (cache_key, lease_id)",
    "e9_semantic_answer_lookup": f"""WITH q AS (SELECT i.vec_id - 1 AS request_id, i.label, i.vec_id % 2 AS flags, i.embedding AS x, coalesce(j.embedding, i.embedding) AS y, 0.2::DOUBLE + 0.05::DOUBLE * (((i.vec_id - 1) // 20) % 10) AS w
  FROM embeddings i LEFT JOIN embeddings j ON j.vec_id = i.vec_id + 1 WHERE (i.vec_id - 1) % 20 = 0),
p AS (SELECT request_id, c.vec_id AS answer_id, [x[k]::DOUBLE + w * y[k]::DOUBLE FOR k IN range(1, len(x) + 1)] AS a, c.embedding AS b FROM q JOIN embeddings c ON c.label = q.label AND c.vec_id % 2 = q.flags AND c.vec_id <> request_id),
s AS (SELECT request_id, answer_id, {COSINE} AS similarity FROM p) SELECT request_id, answer_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.92 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(similarity, 9) DESC, answer_id) = 1""",
    "e10_evict_answers": "SELECT o_custkey AS lease_id, count(*) AS evicted FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3) GROUP BY 1",
    "e11_cap_answers": "SELECT o_orderkey AS answer_id, o_orderdate AS last_used FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 256",
    "e12_cache_hits": f"""WITH {_LOG}, r AS (SELECT request_id, lease_id, cache_key, ts, (SELECT count(*) FROM log i WHERE i.request_id % 97 = 0 AND i.lease_id = l.lease_id AND i.ts <= l.ts) AS epoch FROM log l WHERE request_id % 97 <> 0)
SELECT request_id, epoch, row_number() OVER (PARTITION BY lease_id, cache_key, epoch ORDER BY ts, request_id) > 1 AS hit FROM r""",
    "f1_select_metadata_chunks": _chosen("documents", ("[0-9]{4}", "shand|ndthe", "que la|das")),
    "f1_default_signals": _chosen(f"(SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id > 20 THEN text || chr(10) || {list(SIGNAL_LINES)}[(doc_id // 3) % {len(SIGNAL_LINES)} + 1] ELSE text END AS text FROM documents)", leases.SIGNALS),
    "f3_merge_metadata": f"WITH {_LEASES}, {_PATCH} {_merge('update')} UNION ALL {_merge('missing')}",
    "f4_register_leases": "SELECT o_custkey AS lease_id, o_orderstatus AS name, o_totalprice AS rent, o_orderkey AS row FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "f4_list_leases": """WITH l AS (SELECT o_custkey AS lease_id, o_orderstatus AS name, o_orderdate AS created_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
n AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, lease_id) AS r, count(*) OVER () AS total FROM l), w AS (SELECT c_custkey AS lease_id FROM customer WHERE c_custkey % 50 = 1 UNION ALL SELECT -1)
SELECT lease_id, name, created_at, 'page' AS kind, total FROM n WHERE r BETWEEN 31 AND 60 UNION ALL SELECT w.lease_id, name, created_at, 'get', (SELECT count(*) FROM l) FROM w LEFT JOIN l USING (lease_id)""",
    "f5_lease_status": f"WITH {_LEASES} SELECT lease_id, {_STATUS} AS status FROM leases",
    "f6_portfolio_stats": f"WITH {_LEASES} SELECT count(*) AS total, count(*) FILTER (s = 'active') AS active, count(*) FILTER (s = 'pending') AS pending, round(100 * count(*) FILTER (s = 'active') / count(*))::BIGINT AS active_pct, (SELECT least(count(*), 500) FROM orders) AS comparisons FROM (SELECT {_STATUS} AS s FROM leases)",
    "f7_recent_leases": """SELECT o_orderkey AS lease_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN '1 day' WHEN d < 7 THEN d || ' days' WHEN d < 14 THEN '1 week' WHEN d < 30 THEN (d // 7) || ' weeks' WHEN d < 60 THEN '1 month' ELSE (d // 30) || ' months' END AS age
FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '2001-08-02') AS d FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200)""",
    "f8_search_leases": f"WITH {_LEASES} SELECT lease_id, name, tenant FROM leases WHERE contains(lower(name), '99') OR contains(lower(tenant), '99') UNION ALL SELECT lease_id, name, tenant FROM leases WHERE contains(lower(name), 'house') OR contains(lower(tenant), 'house')",
    "f9_page_rows": """WITH t AS (SELECT c_custkey AS lease_id, c_name AS name, row_number() OVER (ORDER BY c_name) AS r, count(*) OVER () AS total FROM customer)
SELECT lease_id, name, '3' AS page, total FROM t WHERE r BETWEEN 41 AND 60 UNION ALL SELECT lease_id, name, 'last', total FROM t WHERE (r - 1) // 10 = (total - 1) // 10""",
    "f10_age_days": f"SELECT o_orderkey AS lease_id, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 THEN {_AGE} END AS age_days FROM orders",
    "f11_expired_leases": f"SELECT o_orderkey AS lease_id, {_AGE} AS age_days FROM orders WHERE {_AGE} >= 365",
    "f12_purge": f"SELECT o_orderkey AS lease_id, {_AGE} AS age_days, count(l_linenumber) AS n_chunks, count(*) FILTER (l_linenumber = 1) AS n_answers, true AS succeeded, 'retention' AS actor FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE {_AGE} >= 2160 GROUP BY 1, 2",
    "f13_purge_summary": f"SELECT count(*) FILTER ({_AGE} >= 2160) AS eligible, count(*) FILTER ({_AGE} >= 2160) AS succeeded, count(*) FILTER ({_AGE} < 2160) AS records_left FROM orders",
    "f14_cap_history": """WITH k AS (SELECT o_orderkey AS id, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders QUALIFY n <= 500)
SELECT id, created_at, 'all' AS page, count(*) OVER () AS total FROM k UNION ALL SELECT id, created_at, '3', (SELECT count(*) FROM k) FROM k WHERE n BETWEEN 41 AND 60""",
    "f15_group_clauses": f"WITH {_GROUPS} SELECT lease_id, clause_type, chunk_no, n FROM groups",
    "f16_clause_overlap": f"""WITH {_SPARSE}, l AS (SELECT DISTINCT pair_id, clause_type FROM pairs JOIN sparse ON lease_id = left_id), r AS (SELECT DISTINCT pair_id, clause_type FROM pairs JOIN sparse ON lease_id = right_id)
SELECT *, 'shared' AS side FROM (SELECT * FROM l INTERSECT SELECT * FROM r) UNION ALL SELECT *, 'left' FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""",
    "f17_one_sided_diffs": f"""WITH {_SPARSE}, f AS (SELECT lease_id, clause_type, {masked('substring(t, 1, 300)', PII_RULES)} AS t FROM (SELECT lease_id, clause_type, arg_min(text, chunk_no) AS t FROM sparse GROUP BY ALL)),
b AS (SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, coalesce(l.clause_type, r.clause_type) AS clause_type, l.t AS l, r.t AS r FROM (SELECT pair_id, clause_type, t FROM pairs JOIN f ON lease_id = left_id) l FULL JOIN (SELECT pair_id, clause_type, t FROM pairs JOIN f ON lease_id = right_id) r ON l.pair_id = r.pair_id AND l.clause_type = r.clause_type)
SELECT pair_id, clause_type, md5(coalesce(l, 'Not present')) AS l, md5(coalesce(r, 'Not present')) AS r, 'Present in ' || CASE WHEN r IS NULL THEN left_id || ' but missing from ' || right_id ELSE right_id || ' but missing from ' || left_id END AS difference,
  chr(39) || clause_type || chr(39) || ' clause found only in ' || CASE WHEN r IS NULL THEN left_id || ', not in ' || right_id ELSE right_id || ', not in ' || left_id END || '.' AS insight FROM b JOIN pairs USING (pair_id) WHERE l IS NULL OR r IS NULL""",
    "f18_shared_clause_pairs": f"WITH {_SPARSE}, {_JOINED} SELECT pair_id, clause_type, md5(lt) AS l, md5(rt) AS r FROM shared",
    "f19_shared_clause_delta": rf"""WITH {_SPARSE}, {_JOINED}, t AS (SELECT pair_id, clause_type, list_distinct(regexp_extract_all(lower(lt), '[a-z0-9§]+')) AS a, list_distinct(regexp_extract_all(lower(rt), '[a-z0-9§]+')) AS b, list_distinct(regexp_extract_all(lt, '\d+(?:[.,]\d+)*')) AS x, list_distinct(regexp_extract_all(rt, '\d+(?:[.,]\d+)*')) AS y FROM shared)
SELECT pair_id, clause_type, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard, md5(array_to_string(list_sort(list_filter(a, lambda q: NOT list_contains(b, q))), ' ')) AS l, md5(array_to_string(list_sort(list_filter(b, lambda q: NOT list_contains(a, q))), ' ')) AS r,
array_to_string(list_sort(list_filter(x, lambda q: NOT list_contains(y, q))), ' ') AS la, array_to_string(list_sort(list_filter(y, lambda q: NOT list_contains(x, q))), ' ') AS ra FROM t""",
    "f21_missing_leases": f"""WITH {_SPARSE}, s AS (SELECT pair_id, unnest([left_id, right_id]) AS lease_id FROM pairs)
SELECT pair_id, lease_id, 'no record' AS reason FROM s WHERE lease_id NOT IN (SELECT source FROM documents) UNION ALL SELECT pair_id, lease_id, 'no chunks' FROM s WHERE lease_id = 'src4'""",
    "g1_question_scores": f"WITH {_EVAL} SELECT config, query_id, should_refuse, refused, round(rr, 6) AS rr, round(recall, 6) AS recall, round(precision, 6) AS precision FROM s",
    "g5_retrieval_report": f"WITH {_EVAL} SELECT config, category, n, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round(precision, 6) AS precision, round(refusal_accuracy, 6) AS refusal_accuracy FROM report",
    "g6_compare_configs": f"WITH {_EVAL}, o AS (UNPIVOT (SELECT config, mrr, recall, precision, refusal_accuracy FROM report WHERE category = 'overall') ON mrr, recall, precision, refusal_accuracy INTO NAME metric VALUE v) SELECT metric, "
    + ", ".join(f"round(max(v) FILTER (config = '{c}'), 6) AS {c.replace('+', '_')}" for c in CONFIGS) + " FROM o GROUP BY 1",
    "g8_answer_quality": "SELECT round(avg(l_discount) FILTER (u), 6) AS faithfulness, round(avg(l_tax) FILTER (u), 6) AS correctness, round(avg(l_quantity / 100) FILTER (u), 6) AS relevance, round(avg((l_discount + l_tax + l_quantity / 100) / 3) FILTER (u), 6) AS answer_quality, count(*) FILTER (u) AS judged, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS unavailable, count(*) FILTER (u) = 0 AS none_available FROM (SELECT *, l_returnflag <> 'R' AND l_linestatus <> 'F' AS u FROM lineitem)",
    "g9_regression_check": f"SELECT metric, current, prior, round(pct, 6) AS pct, status FROM ({REGRESSION})",
    "g9_tracked_metrics": """WITH m AS (SELECT ['mrr', 'recall', 'precision', 'refusal_accuracy', 'answer_quality', 'latency', 'recall_overall', 'coverage'][p_size % 8 + 1] AS metric, round(avg(p_size), 3) AS current, round(avg(p_retailprice) / 57, 3) AS prior FROM part WHERE p_size <= 50 GROUP BY 1),
p AS (SELECT *, CASE WHEN prior = 0 THEN 0 ELSE (current - prior) / prior * 100 END AS pct FROM m WHERE metric IN ('mrr', 'recall', 'precision', 'refusal_accuracy', 'answer_quality'))
SELECT metric, current, prior, round(pct, 6) AS pct, CASE WHEN pct <= -5 THEN 'REGRESSION' WHEN pct <= -2.5 THEN 'WARN' ELSE 'OK' END AS status FROM p""",
    "g10_quality_floors": f"WITH {_METRICS} SELECT metric, value, 25.0::DOUBLE AS floor FROM cur WHERE value < 25",
    "h1_client_key": "SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id WHEN event_id % 5 > 0 THEN event_type ELSE 'unknown-' || event_id END AS client FROM events",
    "h2_rate_limit": LIMITED,
    "h7_access_log": f"SELECT conv_id, turn, role, {hashed('text')} AS query_hash FROM conversations",
    "h3_over_limit_windows": "SELECT event_id AS request_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW)",
    "h4_count_outcomes": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1",
    "h5_latency_histogram": f"WITH {_HIST} SELECT status, le, n, round(total_ms, 2) AS total_ms FROM h",
    "h6_latency_quantile": f"""WITH {_HIST}, x AS (SELECT *, coalesce(lag(n) OVER w, 0) AS before, CASE WHEN ord = 0 THEN 0 ELSE lag(le_v) OVER w END AS low, 0.95 * max(n) OVER (PARTITION BY status) AS want FROM h WINDOW w AS (PARTITION BY status ORDER BY ord))
SELECT status, round(CASE WHEN le = '+Inf' THEN 10000 ELSE low + (le_v - low) * (want - before) / (n - before) END, 6) AS quantile_ms FROM x WHERE n >= want AND before < want""",
    "h6_merged_sketches": "SELECT event_type AS status, count(value) AS n, true AS near FROM events GROUP BY 1",
    "h7_access_rollup": "SELECT '/r/' || (user_id % 10) AS route, event_type AS status, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL",
}
