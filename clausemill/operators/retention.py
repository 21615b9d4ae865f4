"""Retention over stored tables: a journal of steps, the record last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.sources.store import LeaseStore

from .leases import expired_leases


class Retention:
    """Purges expired leases from stores of artifacts and, last, from the store of records.

    A sweep first writes down which leases it takes and the batch of each store in
    which they go.  A step then writes what it is about to remove (rows by lease, and
    errors), removes it, and marks itself done.  So a sweep that died goes on where
    it was, and one that is run again changes nothing.  A lease with an error in some
    step keeps that artifact and its record, and the next sweep takes it again.
    """

    def __init__(self, spark: SparkSession, root: str, artifacts: dict[str, LeaseStore], records: LeaseStore, kind: str = "records"):
        self.spark, self.root, self.artifacts, self.records, self.kind = spark, root.rstrip("/"), artifacts, records, kind
        self.lease = records.kinds["leases"].split(" ", 1)[1]

    def sweep(self, sweep_id: int, now: str, days: int, failures: DataFrame | None = None, actor: str = "retention") -> DataFrame:
        """One row a lease: age_days, rows removed of each artifact, errors, succeeded, actor; ``failures`` is (lease_id, step, error)."""
        folder = f"{self.root}/sweep={sweep_id}"
        if not self._done(f"{folder}/plan"):
            old = expired_leases(self.records.read(self.kind), now, days).groupBy("lease_id").agg(F.max("age_days").alias("age_days"))
            old.write.mode("overwrite").parquet(f"{folder}/leases")
            batches = [(name, 1 + max([n for own in store.folders().values() for n in own], default=-1)) for name, store in [*self.artifacts.items(), ("", self.records)]]
            self.spark.createDataFrame(batches, "step string, batch long").write.mode("overwrite").parquet(f"{folder}/batches")
            self._mark(f"{folder}/plan")
        taken = self.spark.read.schema(f"lease_id {self.lease}, age_days double").parquet(f"{folder}/leases")
        batch = {r.step: r.batch for r in self.spark.read.schema("step string, batch long").parquet(f"{folder}/batches").collect()}  # one row a store
        report = taken
        errors = self.spark.createDataFrame([], f"lease_id {self.lease}, error string")
        for name, store in self.artifacts.items():
            step = self._step(f"{folder}/{name}", name, store, taken, batch[name], failures)
            report = report.join(step.select("lease_id", F.col("n").alias(f"n_{name}")), "lease_id", "left")
            errors = errors.unionByName(step.where("error is not null").select("lease_id", F.concat_ws(": ", F.lit(name), "error").alias("error")))
        bad = errors.groupBy("lease_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))  # one at most for each step
        none = F.array().cast("array<string>")
        report = report.join(bad, "lease_id", "left").withColumn("errors", F.coalesce("errors", none)).withColumn("succeeded", F.size("errors") == 0)
        if not self._done(f"{folder}/records"):
            self.records.remove(report.where("succeeded").select("lease_id"), batch[""])
            self._mark(f"{folder}/records")
        return report.withColumn("actor", F.lit(actor))

    def _step(self, folder: str, name: str, store: LeaseStore, taken: DataFrame, batch: int, failures: DataFrame | None) -> DataFrame:
        """(lease_id, n, error) of a step, done now or before."""
        if not self._done(f"{folder}/written"):
            rows = store.read(name, store.touched(taken)).join(taken.select("lease_id"), "lease_id", "left_semi").groupBy("lease_id").agg(F.count("*").alias("n"))
            failed = failures.where(F.col("step") == name).groupBy("lease_id").agg(F.min("error").alias("error")) if failures is not None else self.spark.createDataFrame([], f"lease_id {self.lease}, error string")
            out = taken.select("lease_id").join(rows, "lease_id", "left").join(failed, "lease_id", "left")
            out.select("lease_id", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).alias("n"), "error").write.mode("overwrite").parquet(f"{folder}/rows")
            self._mark(f"{folder}/written")
        known = self.spark.read.schema(f"lease_id {self.lease}, n long, error string").parquet(f"{folder}/rows")
        if not self._done(f"{folder}/removed"):
            store.remove(known.where("error is null").select("lease_id"), batch)
            self._mark(f"{folder}/removed")
        return known

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{name}._DONE")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _done(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def _mark(self, name: str) -> None:
        fs, path = self._path(name)
        fs.create(path, True).close()
