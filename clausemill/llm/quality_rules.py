"""Quality rules as weak supervision, in DataFrame operations only.

Each rule looks at one measure of a text and votes bad (1), good (0) or abstains
(null).  Every kind of junk moves at least two rules, as votes that agree with
no other rule's carry no evidence.  Expectation-maximisation over the counts of vote patterns estimates how
often each rule gives each vote on good and on bad documents; a document's
posterior follows from its votes.  Patterns number at most 3 ** len(RULES),
whatever the table, so only they reach the driver.

Measures (null text: none, all zero):
  n_words         maximal runs of characters other than 0x20, 0x09-0x0D
  word_chars      code points in words
  n_symbols       characters of ``#*$%&|<>``
  n_dup_lines     lines with a word that equal an earlier line
  n_repeat_words  words inside 5-word windows found twice or more in the text
  n_distinct      sum of the distinct words of each consecutive block of BLOCK words

``n_distinct / n_words`` is the share of distinct words, averaged over all blocks of
the text, each with the weight of its words; it does not sink with the length of a
text, as the share over the whole text would.

Defined results: null, empty or blank text fails the base; repeated rows and null
ids pass through one for one; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 5
BLOCK = 2000
#: Base rule: fewer words fail, and more than this percentage of repeated words.
LEAST_WORDS = 10
MOST_REPEATED = 20
ITERATIONS = 40


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where ``measure`` passes a bound; abstains between them."""

    name: str
    measure: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.measure} {self.bad} THEN 1 WHEN {self.measure} {self.good} THEN 0 END")


RULES = (
    Rule("symbols", "n_symbols / nullif(word_chars, 0)", "> 0.05", "< 0.01"),
    Rule("marked_words", "n_symbol_runs / nullif(n_words, 0)", "> 0.10", "< 0.03"),
    Rule("shouts", "n_shouts / nullif(n_words, 0)", "> 0.10", "< 0.03"),
    Rule("capitals", "n_upper / nullif(word_chars, 0)", "> 0.30", "< 0.10"),
    Rule("variety", "n_distinct / nullif(n_words, 0)", "< 0.30", "> 0.45"),
    Rule("word_length", "word_chars / nullif(n_words, 0)", "> 12 or word_chars / nullif(n_words, 0) < 2.5", "between 3.5 and 8"),
    Rule("lines", "n_dup_lines / nullif(n_lines, 0)", "> 0.30", "< 0.10"),
    Rule("repeats", "n_repeat_words / nullif(n_words, 0)", "> 0.20", "< 0.05"),
    Rule("stops", "n_stops / nullif(n_words, 0)", "< 0.004", "> 0.02"),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every text, without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    w = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPLIT), lambda x: x != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
    )
    w = w.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.regexp_extract_all("text", F.lit("[#*$%&|<>]+"), F.lit(0))).cast("long").alias("n_symbol_runs"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_shouts"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", ".!?", ""))).cast("long").alias("n_stops"),
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(BLOCK)),
            F.lit(0).cast("long"),
            lambda total, i: total + F.size(F.array_distinct(F.slice("w", i, BLOCK))),
        ).alias("n_distinct"),
        F.when(
            F.size("w") > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))),
        ).alias("windows"),
    )
    # only a text with an equal pair of windows needs their places
    w = w.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")))
    w = w.withColumn("ordered", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).drop("windows")
    n = F.size("ordered")
    nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    w = w.withColumn(
        "as_before",
        F.zip_with("ordered", F.concat(nothing, F.slice("ordered", F.lit(1), n - 1)), lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("e"))),
    ).drop("ordered")
    nothing = F.array(F.lit(None).cast("struct<i:int,e:boolean>"))
    w = w.withColumn(
        "places",
        F.sort_array(
            F.array_compact(
                F.zip_with("as_before", F.concat(F.slice("as_before", F.lit(2), F.size("as_before")), nothing), lambda x, y: F.when(x["e"] | F.coalesce(y["e"], F.lit(False)), x["i"]))
            )
        ),
    ).drop("as_before")
    steps = F.zip_with("places", F.slice("places", F.lit(2), F.size("places")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return w.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("places")


def fit(votes: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = ITERATIONS) -> tuple[float, list[dict]]:
    """Prior of bad, and for each rule the log-odds of bad that each vote gives.

    ``votes`` has a column for each rule.  Starts from the belief that a rule
    seldom votes bad on a good document.  Counts are smoothed by one pseudo-vote
    of each kind.
    """
    names = [r.name for r in rules]
    rows = votes.groupBy(*names).count().collect()  # at most 3 ** len(rules)
    patterns = [(tuple(row[n] for n in names), row["count"]) for row in rows]
    weight = []
    for pattern, _ in patterns:
        weight.append(0.95 if 1 in pattern else 0.05)
    prior, tables = 0.5, [dict.fromkeys((0, 1, None), 0.0) for _ in names]
    for _ in range(iterations):
        total = sum(c for _, c in patterns)
        bad = sum(c * p for (_, c), p in zip(patterns, weight, strict=True))
        prior = (bad + 1) / (total + 2)
        for k in range(len(names)):
            for vote in (0, 1, None):
                b = sum(c * p for (v, c), p in zip(patterns, weight, strict=True) if v[k] == vote)
                g = sum(c * (1 - p) for (v, c), p in zip(patterns, weight, strict=True) if v[k] == vote)
                tables[k][vote] = math.log((b + 1) / (bad + 3)) - math.log((g + 1) / (total - bad + 3))
        base = math.log(prior / (1 - prior))
        weight = [1 / (1 + math.exp(-max(-500.0, min(500.0, base + sum(t[v] for t, v in zip(tables, pattern, strict=True)))))) for pattern, _ in patterns]
    return prior, tables


def posterior(prior: float, tables: list[dict], rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a document is good, from its vote columns."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for rule, table in zip(rules, tables, strict=True):
        odds += F.when(F.col(rule.name) == 1, table[1]).when(F.col(rule.name) == 0, table[0]).otherwise(table[None])
    return 1 / (1 + F.exp(odds))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base_failed, quality (posterior of good) and kept for every document.

    The model is fitted on the documents that pass the base rule.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    known = saved(measures(docs).withColumn("base_failed", base), "quality-measures")  # a few numbers a document
    voted = known.select("*", *(r.vote().alias(r.name) for r in rules))
    prior, tables = fit(voted.where(~F.col("base_failed")), rules)
    voted = voted.withColumn("quality", posterior(prior, tables, rules))
    kept = ~F.col("base_failed") & (F.col("quality") >= 0.5)
    return voted.select(*known.columns, "quality", kept.alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, the posterior and the verdict for every document."""
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
