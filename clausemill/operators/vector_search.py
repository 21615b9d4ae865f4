"""Nearest vectors: exact tiles for many questions, a stored coarse index, and exact angle bounds for a threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.functions.vectors import cosine
from clausemill.sources.store import LeaseStore
from clausemill.sources.tables import saved

#: Questions and vectors of one tile.
TILE_QUESTIONS, TILE_VECTORS = 512, 4096
#: Blocks of questions and of vectors that a lease has at most, until a block's entries take so many bytes.
MOST_BLOCKS, SIDE_BYTES = (8, 32), 32 << 20
#: Vectors that cells and pivots are chosen from; all others are only assigned to them.
SAMPLE = 8_192


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Unit rows of a column of vectors; zero where a vector is null, has another length, a null entry, or is zero itself."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    entries = np.asarray(pc.list_flatten(column).cast(pa.float64()).fill_null(np.nan))
    out = np.zeros((len(column), d))
    out[lengths == d] = entries[np.repeat(lengths == d, lengths)].reshape((lengths == d).sum(), d)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=(size > 0) & np.isfinite(size))


def lengths_of(column: pa.Array) -> list[int]:
    """The lengths of vectors that occur, the most frequent first, of equals the larger."""
    sizes, counts = np.unique(np.asarray(pc.list_value_length(column).fill_null(0), np.int64), return_counts=True)
    return [int(sizes[k]) for k in np.lexsort((-sizes, -counts)) if sizes[k]]


def nearest(mine: pa.Array, theirs: pa.Array, own: np.ndarray, others: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, distance) of the k nearest of each of some vectors among others, of equal distances the earlier; ``own`` and ``others`` number their ids.

    Vectors are multiplied 512 by 4096 at a time, and of each product only what may
    be among the k best is sorted, so memory and time are those of the products.
    """
    left, right = ({d: matrix(column, d) for d in lengths_of(mine)} for column in (mine, theirs))
    found = []
    for q in range(0, len(own), 512):
        best = []
        for c in range(0, len(others), 4096):
            far = 1 - sum((left[d][q : q + 512] @ right[d][c : c + 4096].T for d in left), np.zeros((len(own[q : q + 512]), len(others[c : c + 4096]))))
            if not itself:
                far[own[q : q + 512, None] == others[c : c + 4096]] = np.inf
            near = np.round(far, 9)
            at = min(k, near.shape[1]) - 1
            rows, columns = np.nonzero((near <= np.partition(near, at, axis=1)[:, at : at + 1]) & np.isfinite(near))
            best.append((rows + q, columns + c, far[rows, columns]))
        rows, columns, far = (np.concatenate(x) for x in zip(*best, strict=True))
        order = np.lexsort((columns, np.round(far, 9), rows))
        rows, columns, far = rows[order], columns[order], far[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((rows[first], columns[first], far[first]))
    rows, columns, far = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows, columns, far


def tiled_topk(queries: DataFrame, candidates: DataFrame, k: int, itself: bool = False, questions: int = TILE_QUESTIONS, vectors: int = TILE_VECTORS, on: tuple[str, ...] = ("lease_id",)) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the exact k nearest of equal ``on``, for any number of questions.

    Questions and vectors of a lease are cut into blocks by hash, as many as its
    counts ask for.  Each pair of blocks is a tile, which one task multiplies; it
    sends on the k best of each of its questions.  So a lease, however large, is as
    many tasks as it has tiles, and what is shuffled last is k rows a question and
    block.  A vector is sent once for each block of questions and a question once
    for each block of vectors, so the sides of tiles (at least ``questions`` and
    ``vectors``) grow with the counts: up to SIDE_BYTES a lease has at most
    MOST_BLOCKS of each, and what is shuffled grows as the tables do.
    """

    def cut(rows: DataFrame, side: int, most: int, name: str) -> DataFrame:
        held = F.greatest(F.lit(side), F.floor(F.lit(SIDE_BYTES) / (8 * F.greatest(F.coalesce(F.avg(F.size("embedding")), F.lit(1)), F.lit(1)))))
        rows_of = F.least(F.greatest(F.lit(side), F.ceil(F.count("*") / most)), held)
        return rows.groupBy(*on).agg(F.ceil(F.count("*") / rows_of).cast("int").alias(name))

    blocks = saved(cut(queries, questions, MOST_BLOCKS[0], "q_blocks").join(cut(candidates, vectors, MOST_BLOCKS[1], "c_blocks"), list(on)), "blocks")

    def placed(rows: DataFrame, name: str, side: str, own: str, other: str):
        # new names on each side, as both may come from one table
        mine = [f"{side}_{c}" for c in on]
        rows = rows.select(*(F.col(c).alias(f"{side}_{c}") for c in on), F.col(name).alias("id"), F.col("embedding").alias("v"))
        rows = rows.join(blocks, [F.col(m) == F.col(c) for m, c in zip(mine, on, strict=True)])
        ends = {own: F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        rows = rows.select(*mine, "id", "v", *(ends[c].alias(f"{side}_{c}") for c in ("q_blocks", "c_blocks")))
        return rows.groupBy(*mine, f"{side}_q_blocks", f"{side}_c_blocks")

    asks, have = placed(queries, "query_id", "q", "q_blocks", "c_blocks"), placed(candidates, "chunk_id", "c", "c_blocks", "q_blocks")
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), candidates.schema["chunk_id"].dataType.simpleString()

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "distance"]
        ids, own = left.column("id").combine_chunks(), right.column("id").combine_chunks()
        if not len(ids) or not len(own):
            return pa.table([ids.slice(0, 0), own.slice(0, 0), pa.array([], pa.float64())], names)
        order = pc.sort_indices(own)  # of equal distances the smaller id comes first
        own, mine, theirs = own.take(order), left.column("v").combine_chunks(), right.column("v").combine_chunks().take(order)
        numbers: dict = {}
        others = np.array([numbers.setdefault(x, len(numbers)) for x in own.to_pylist()])
        rows, best, far = nearest(mine, theirs, np.array([numbers.get(x, -1) for x in ids.to_pylist()]), others, k, itself)
        return pa.table([ids.take(pa.array(rows)), own.take(pa.array(best)), pa.array(far)], names)

    found = asks.cogroup(have).applyInArrow(tile, f"query_id {q_type}, chunk_id {c_type}, distance double")
    from .retrieval import ranked

    return ranked(found, k, F.round("distance", 9).asc())


def spread_out(vectors: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """Up to ``count`` of some unit vectors, each as far as can be from those before it."""
    if not len(vectors):
        return vectors
    picked = [int(np.random.Generator(np.random.PCG64(seed)).integers(len(vectors)))]
    near = vectors @ vectors[picked[0]]
    while len(picked) < min(count, len(vectors)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[picked[-1]])
    return vectors[picked]


def sampled(rows: DataFrame, name: str = "chunk_id", most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, their leases by number) of a bounded sample by a hash of ids."""
    n = rows.count()
    some = rows if n <= most else rows.where(F.pmod(F.xxhash64(name), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))
    got = some.select("embedding", F.xxhash64("lease_id").alias("lease")).where("embedding is not null").limit(2 * most).toArrow()
    column = got.column("embedding").combine_chunks()
    lengths = lengths_of(column)
    out = matrix(column, lengths[0]) if lengths else np.zeros((len(column), 0))
    usable = np.linalg.norm(out, axis=1) > 0.5
    return out[usable], np.asarray(got.column("lease"))[usable]


def lloyd(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``count`` cells, refined from well-spread vectors."""
    centres = spread_out(vectors, count)
    for _ in range(rounds if len(centres) else 0):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def probes_for(vectors: np.ndarray, leases: np.ndarray, centres: np.ndarray, k: int, target: float, questions: int = 256) -> int:
    """The fewest cells to visit for the share ``target`` of the k nearest of some vectors among those of their lease."""
    step = max(1, len(vectors) // questions)
    asked = vectors[::step]
    near = np.where(leases[::step, None] == leases, asked @ vectors.T, -2)
    near[np.arange(len(asked)), np.arange(len(asked)) * step] = -2  # not itself
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    own = (vectors @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, own[best], axis=1)[np.take_along_axis(near, best, axis=1) > -2]
    if not len(ranks):
        return len(centres)
    found = np.cumsum(np.bincount(ranks, minlength=len(centres))) / len(ranks)
    return int(np.searchsorted(found, target) + 1)


def with_cells(rows: DataFrame, name: str, centres: np.ndarray, count: int = 1) -> DataFrame:
    """(lease_id, name, embedding, cells): the nearest centres of each vector, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = matrix(part.column("embedding"), centres.shape[1]) @ centres.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :count].astype(np.int32)
                bounds = pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lease_id", name, "embedding")), pa.ListArray.from_arrays(bounds, pa.array(best.ravel()))], ["lease_id", name, "embedding", "cells"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("lease_id", name)}
    return rows.select("lease_id", name, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"lease_id {kinds['lease_id']}, {name} {kinds[name]}, embedding array<double>, cells array<int>")


class VectorIndex:
    """Vectors kept on disk by lease and, inside a lease, by the cell of a coarse quantiser.

    The centres are fitted once on a bounded sample and kept beside the vectors, of
    which every one is indexed.  The fit also measures on the sample how many cells a
    question has to visit for the recall that is asked for.  A batch brings leases
    with all their vectors and replaces what the index had of them.  A search reads
    the buckets of its leases, compares a question with the vectors of its nearest
    cells, and scores those exactly.
    """

    #: Number of the layout on disk.
    LAYOUT = 1
    CENTRES = "cell int, probes int, centre array<double>"

    def __init__(self, spark: SparkSession, root: str, lease: str = "string", chunk: str = "string", buckets: int = 32):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = LeaseStore(spark, root, {"vectors": f"lease_id {lease}, chunk_id {chunk}, cell int, embedding array<double>"}, buckets, lease)

    def fit(self, rows: DataFrame, cells: int = 64, k: int = 5, recall: float = 0.97, most: int = SAMPLE) -> None:
        vectors, leases = sampled(rows, most=most)
        centres = lloyd(vectors, cells)
        probes = probes_for(vectors, leases, centres, k, recall) if len(centres) else 0
        table = self.spark.createDataFrame([(j, probes, [float(x) for x in c]) for j, c in enumerate(centres)], self.CENTRES)
        table.repartition(1).write.mode("overwrite").parquet(f"{self.root}/centres")

    def centres(self) -> tuple[np.ndarray, int]:
        """(the centre of each cell, cells to visit)."""
        rows = sorted(self.spark.read.schema(self.CENTRES).parquet(f"{self.root}/centres").collect())  # one row a cell
        return (np.array([r.centre for r in rows]), rows[0].probes) if rows else (np.zeros((0, 0)), 0)

    def update(self, rows: DataFrame, batch_id: int) -> None:
        """Index the leases of ``rows`` (lease_id, chunk_id, embedding) anew."""
        placed = with_cells(rows, "chunk_id", self.centres()[0]).select("lease_id", "chunk_id", F.coalesce(F.get("cells", 0), F.lit(-1)).alias("cell"), "embedding")
        self.store.put(batch_id, "vectors", placed, ["lease_id", "cell", "chunk_id"])
        self.store.put(batch_id, "leases", self.store.read("vectors", batch=batch_id).select("lease_id").distinct())

    def search(self, queries: DataFrame, k: int, probes: int | None = None, itself: bool = False) -> DataFrame:
        """(query_id, chunk_id, distance, rank) of the k nearest among the vectors of the ``probes`` nearest cells, by default as many as the fit found."""
        from .retrieval import BROADCAST_ASKS, bounded, ranked

        centres, enough = self.centres()
        asks = with_cells(queries, "query_id", centres, probes or enough).select("lease_id", "query_id", "embedding", F.explode("cells").alias("cell"))
        rows = self.store.read("vectors", self.store.touched(queries))
        if queries.limit(BROADCAST_ASKS + 1).count() > BROADCAST_ASKS:
            return tiled_topk(asks, rows, k, itself, on=("lease_id", "cell"))
        pairs = rows.join(bounded(asks.withColumnRenamed("embedding", "q")), ["lease_id", "cell"])
        pairs = pairs if itself else pairs.where("query_id <> chunk_id")
        return ranked(pairs.select("query_id", "chunk_id", (1 - cosine("q", "embedding")).alias("distance")), k, F.round("distance", 9).asc())


def angles(rows: DataFrame, name: str, pivots: np.ndarray, key: list[str]) -> DataFrame:
    """(key, name, embedding, pivot, angle, all angles): the nearest pivot of each usable vector and its angles to all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit = matrix(part.column("embedding"), pivots.shape[1])
                usable = np.flatnonzero(np.linalg.norm(unit, axis=1) > 0.5)
                turn = np.arccos(np.clip(unit[usable] @ pivots.T, -1, 1))
                best = turn.argmin(axis=1)
                bounds = pa.array(np.arange(len(usable) + 1, dtype=np.int32) * turn.shape[1])
                own = [part.column(c).take(pa.array(usable)) for c in (*key, name, "embedding")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(best.astype(np.int32)), pa.array(turn[np.arange(len(best)), best]), pa.ListArray.from_arrays(bounds, pa.array(turn.ravel()))], [*key, name, "embedding", "pivot", "angle", "turns"]
                )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*key, name))
    return rows.select(*key, name, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"{kinds}, embedding array<double>, pivot int, angle double, turns array<double>")


def angle_candidates(asks: DataFrame, have: DataFrame, least: float, key: list[str], pivots: int = 64, most: int = SAMPLE) -> DataFrame:
    """(request_id, answer_id, q, embedding): all pairs of equal ``key`` with a cosine of at least ``least``, among few others.

    Angles between vectors obey the triangle inequality, so two vectors within the
    angle t of the threshold differ by at most t in their angle to any pivot.  Every
    answer lies in the cell of its nearest pivot, on a ring there by its angle.  A
    question visits the cells that may hold an answer within t (the pivot is at most
    2 t farther than its nearest one), of those the rings it can reach, and leaves
    out answers that another pivot's bound excludes before their vectors are
    compared.  Pivots are well-spread vectors of a bounded sample; any would give
    the same rows.
    """
    if least <= 0:
        raise ValueError("the angle bound needs a threshold over 0")
    t = math.acos(min(1.0, least)) + 1e-9
    ring = max(t, 1e-3)
    chosen = spread_out(sampled(have, "answer_id", most)[0], pivots)
    if not len(chosen):  # no answer has a vector
        chosen = np.zeros((1, 1))
    stored = angles(have, "answer_id", chosen, key).select(*key, "answer_id", "embedding", "turns", "pivot", F.floor(F.col("angle") / ring).cast("int").alias("ring"))
    asked = angles(asks, "request_id", chosen, key)
    visits = F.filter(F.transform("turns", lambda a, i: F.struct(i.alias("pivot"), a.alias("a"))), lambda x: x["a"] <= F.col("angle") + 2 * t)
    asked = asked.select(*key, "request_id", F.col("embedding").alias("q"), F.col("turns").alias("q_turns"), F.inline(visits))
    reach = F.sequence(F.greatest(F.floor((F.col("a") - t) / ring), F.lit(0)).cast("int"), F.floor((F.col("a") + t) / ring).cast("int"))
    asked = asked.select(*key, "request_id", "q", "q_turns", "pivot", F.explode(reach).alias("ring"))
    from .retrieval import bounded

    pairs = stored.join(bounded(asked), [*key, "pivot", "ring"])
    apart = F.exists(F.zip_with("turns", "q_turns", lambda a, b: F.abs(a - b) > t), lambda x: x)
    return pairs.where(~apart).select("request_id", "answer_id", "q", "embedding")


def similar_pairs(asks: DataFrame, have: DataFrame, least: float, key: list[str], itself: bool = True, pivots: int = 64) -> DataFrame:
    """(request_id, answer_id, similarity) of all pairs of equal ``key`` with a cosine of at least ``least``, exactly; an answer asked by its own id only if ``itself``."""
    pairs = angle_candidates(asks, have, least, key, pivots)
    pairs = pairs if itself else pairs.where("request_id <> answer_id")
    return pairs.select("request_id", "answer_id", cosine("q", "embedding").alias("similarity")).where(F.col("similarity") >= least)
