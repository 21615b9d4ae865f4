"""The corpus pipeline: five stages over ``documents``, each by one operator of clausemill.llm.

1. toxicity: documents scored toxic go.
2. jaccard: of every group of near-duplicates the smallest doc_id stays.
3. substring: words of windows that an earlier document has are cut out of the
   texts; a document of which nothing is left goes.
4. decontaminate: documents with a passage of a benchmark item go.
5. encode: byte-level BPE of the texts that are left, as digests.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  All
but the last return the columns of ``documents``, whatever other columns ``docs``
has.  Rows with a null doc_id pass stages 2 to 4, as no operator can name them.  Null,
empty and blank texts pass every stage and have no tokens; of repeated rows with one
id all stay or all go; of ties between groups of equal documents the smallest doc_id
stays; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm import bpe, decontaminate, jaccard, substring, toxicity
from clausemill.llm.tables import drop, saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model is fitted on their labels."""
    model = toxicity.fit_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard links."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of earlier documents; texts with none stay as they are."""
    found = substring.deduplicated(docs.select(*COLUMNS))
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    rows = found.where(~cut | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    return rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_duplicates),
    ("substring", cut_repeated_passages),
    ("decontaminate", drop_benchmark),
    ("encode", encode),
]

#: Learned scores and byte-pair merges are beyond SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each one's rows written before the next reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
