"""Readers and writers of pages, golden questions, stores and reports."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "lease_id string, source string, page int, text string"
GOLDEN = "question string, relevant_clause_ids array<string>, reference_answer string, category string, should_refuse boolean"
CHUNKS = "lease_id string, source string, page int, clause_no int, part_no int, text string, clause_type string, chunk_no long, chunk_id string"
#: For a new table of very many folders: tasks move their own into place, where the driver would move all one by one at the end.
MANY_FOLDERS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
#: Tables under so many bytes are left in few tasks.
SPREAD_BYTES = 4 << 20
CATEGORIES = ("factual", "statute", "red_flag", "out_of_scope")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text drops, one file a lease and pages between form feeds: (lease_id, source, page, text), empty pages kept.

    The lease is the name of the file without its ending, or that of a folder
    ``lease_id=...`` around it.
    """
    rows = spark.read.text(path, wholetext=True)
    file = F.col("_metadata.file_name")
    lease = F.col("lease_id").cast("string") if "lease_id" in rows.columns else F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    rows = rows.select(lease.alias("lease_id"), file.alias("source"), "value")
    return rows.select("lease_id", "source", F.posexplode(F.split("value", "\f")).alias("i", "text")).select("lease_id", "source", (F.col("i") + 1).alias("page"), "text")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, mime) of files of any kind; the type by the ending of the name or of a folder ``type=...`` around it.

    Spark's readers give no row for a file without bytes, so one is not seen here.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.coalesce(F.nullif(F.regexp_extract("path", r"/type=([^/]+)/", 1), F.lit("")), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    mime = F.when(kind == "pdf", "application/pdf").when(kind == "txt", "text/plain")
    return rows.select("path", "length", "content", mime.alias("mime"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of golden questions; blank lines are skipped, a bad line or category fails the read."""
    rows = spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)
    allowed = F.col("category").isin(*CATEGORIES)
    return rows.withColumn("category", F.when(allowed, F.col("category")).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce("category", F.lit("null"))))))


def read_json_store(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, number of lines that could not be read) of a JSON store; such lines are left out."""
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*").drop("_corrupt"), rows.agg(F.count_if(bad).alias("corrupt"))


def write_json_store(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_chunks(chunks: DataFrame, target: str) -> None:
    """Replace the chunks of the leases in ``chunks``; other leases' partitions stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lease_id").parquet(target)


def write_eval_report(report: DataFrame, path: str, at: str) -> None:
    """The report rows as JSON with a time stamp."""
    report.withColumn("generated_at", F.lit(at)).write.mode("overwrite").json(path)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; in local mode (tests), where it is unset, a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, least: int = SPREAD_BYTES) -> DataFrame:
    """A table whose files give fewer tasks than there are cores, dealt out over all of them; other and small tables as they are.

    Work on texts costs far more than moving them once, and a file with one row group
    is one task.  Tables of many files have tasks enough and are not shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < least or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(4 * cores)


def version(df: DataFrame) -> str:
    """A digest of the names, lengths and times of the files that a table is read from."""
    spark, seen = df.sparkSession, hashlib.sha256()
    for file in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:16]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several plans read, and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` once nothing reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
