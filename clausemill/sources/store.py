"""Tables kept on disk by lease, in batches, of which each lease's last one counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the table of last batches up to this many are sent to every executor; more are joined by a shuffle.
BROADCAST_LEASES = 100_000


class LeaseStore:
    """``root/<kind>/bucket=b/batch_id=n``: the rows of kind in batch n of the leases whose hash is b.

    A batch brings the whole rows of the leases it touches.  It adds one folder to
    the buckets of those leases and rewrites nothing else; a replay overwrites its
    own folders.  The kind ``leases`` is written last and says which batches a lease
    is in, so a batch that failed half-way is not seen.  Reads name the folders they
    need, so a read of some leases lists and scans their buckets alone.  ``compact``
    folds the batches of a bucket into one.  One job writes at a time.
    """

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, str], buckets: int = 32, lease: str = "string"):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.kinds = kinds | {"leases": f"lease_id {lease}"}
        self._finish()

    def bucket(self, lease: Column | str = "lease_id") -> Column:
        return F.pmod(F.xxhash64(F.col(lease) if isinstance(lease, str) else lease), F.lit(self.buckets)).cast("int")

    def folders(self, kind: str = "leases") -> dict[int, list[int]]:
        """The batches of each bucket of a kind, by listing its folders (buckets times batches at most)."""
        found = {}
        for bucket in self._children(f"{self.root}/{kind}", "bucket="):
            found[bucket] = sorted(self._children(f"{self.root}/{kind}/bucket={bucket}", "batch_id="))
        return found

    def touched(self, leases: DataFrame) -> list[int]:
        """The buckets of some leases; at most all buckets."""
        return sorted(r.b for r in leases.select(self.bucket().alias("b")).distinct().collect())

    def write(self, batch_id: int, leases: DataFrame, order: dict[str, list[str]] | None = None, few: bool = False, **tables: DataFrame) -> None:
        """One batch: the leases it brings and their rows of some kinds, each sorted by ``order`` inside its files; ``few`` as in ``put``."""
        for kind, rows in tables.items():
            self.put(batch_id, kind, rows, (order or {}).get(kind, ["lease_id"]), few=few)
        self.put(batch_id, "leases", leases.select("lease_id").distinct(), few=few)

    def put(self, batch_id: int, kind: str, rows: DataFrame, order: Iterable[str] = ("lease_id",), part: Column | None = None, few: bool = False) -> None:
        """The rows of one kind of a batch; it is not seen before ``leases`` is put.

        ``part`` may number the parts that a large lease is written in.  Rows of a
        ``few`` buckets are written by the tasks that have them, without a shuffle.
        """
        names = self.spark.createDataFrame([], self.kinds[kind]).columns
        place = {"bucket": self.bucket(), "batch_id": F.lit(batch_id).cast("long"), "_part": F.lit(0) if part is None else part}
        # full partitions whatever the sizes of the buckets: a hot one is split, small ones share a task
        rows = rows.withColumns(place)
        rows = (rows if few else rows.hint("rebalance", "bucket", "_part")).sortWithinPartitions("bucket", "batch_id", *order).select(*names, "bucket", "batch_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(f"{self.root}/{kind}")

    def remove(self, leases: DataFrame, batch_id: int) -> None:
        """Take leases out: a batch that has no rows of them."""
        self.put(batch_id, "leases", leases.select("lease_id").distinct())

    def read(self, kind: str, buckets: Iterable[int] | None = None, before: int | None = None, batch: int | None = None) -> DataFrame:
        """The rows in force of some buckets, or of all: those of the last batch (under ``before``) of their lease.

        With ``batch`` the rows of that batch instead.  Buckets of a single batch need no comparison.
        """
        seen, have = self.folders(), self.folders(kind)
        wanted = {b: [n for n in seen.get(b, []) if before is None or n < before] for b in (seen if buckets is None else buckets)}
        if batch is not None:
            wanted = {b: [batch] for b in (have if buckets is None else buckets)}
        wanted = {b: own for b, own in wanted.items() if own}
        single = [(b, own[0]) for b, own in wanted.items() if len(own) == 1]
        several = [(b, n) for b, own in wanted.items() if len(own) > 1 for n in own]
        rows = self._rows(kind, [(b, n) for b, n in single if n in have.get(b, [])])
        if several:
            last = self._rows("leases", several).groupBy("lease_id").agg(F.max("batch_id").alias("batch_id"))
            last = F.broadcast(last) if last.limit(BROADCAST_LEASES + 1).count() <= BROADCAST_LEASES else last
            rows = rows.unionByName(self._rows(kind, [(b, n) for b, n in several if n in have.get(b, [])]).join(last, ["lease_id", "batch_id"], "left_semi"))
        return rows.drop("bucket", "batch_id")

    def compact(self, most: int = 8, before: int | None = None) -> list[int]:
        """Fold the batches (under ``before``) of each bucket that has over ``most`` into the last of them; returns those buckets.

        A job that replays batches folds only those before the one it is at, as a
        replay overwrites its folders.
        The folded rows are written beside the store first.  Once all are there, a
        marker says so, and folders are exchanged one by one; a job that dies in
        between finishes the exchange when it opens the store again.
        """
        batches = {b: [n for n in own if before is None or n < before] for b, own in self.folders().items()}
        full = [b for b, own in batches.items() if len(own) > most]
        if not full:
            return []
        self._delete(f"{self.root}/_folded")
        for kind in self.kinds:
            rows = self.read(kind, full, before).withColumn("bucket", self.bucket())
            top = F.create_map(*(F.lit(x) for b in full for x in (b, max(batches[b]))))
            rows = rows.withColumn("batch_id", top[F.col("bucket")].cast("long")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "batch_id", "lease_id")
            rows.write.partitionBy("bucket", "batch_id").parquet(f"{self.root}/_folded/{kind}")
        fs, path = self._path(f"{self.root}/_folded/_DONE")
        fs.create(path).close()
        self._finish()
        return full

    def _finish(self) -> None:
        """Exchange folded folders, if a compaction got as far as that."""
        fs, done = self._path(f"{self.root}/_folded/_DONE")
        if not fs.exists(done):
            return
        for bucket in self._children(f"{self.root}/_folded/leases", "bucket="):
            for batch in self._children(f"{self.root}/_folded/leases/bucket={bucket}", "batch_id="):
                for kind in self.kinds:  # the leases come last: they tell what is still to be exchanged
                    self._exchange(kind, bucket, batch)
        self._delete(f"{self.root}/_folded")

    def _exchange(self, kind: str, bucket: int, batch: int) -> None:
        folder = f"bucket={bucket}/batch_id={batch}"
        fs, source = self._path(f"{self.root}/_folded/{kind}/{folder}")
        _, target = self._path(f"{self.root}/{kind}/{folder}")
        folded = fs.exists(source)  # else it was moved before, or the kind has no rows here
        for old in self._children(f"{self.root}/{kind}/bucket={bucket}", "batch_id="):
            if old < batch or folded and old == batch:
                self._delete(f"{self.root}/{kind}/bucket={bucket}/batch_id={old}")
        if folded:
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"could not move {source} to {target}")

    def _rows(self, kind: str, folders: list[tuple[int, int]]) -> DataFrame:
        schema = f"{self.kinds[kind]}, bucket int, batch_id long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{kind}/bucket={b}/batch_id={n}" for b, n in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _children(self, folder: str, prefix: str) -> list[int]:
        fs, path = self._path(folder)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]

    def _delete(self, folder: str) -> None:
        fs, path = self._path(folder)
        fs.delete(path, True)
