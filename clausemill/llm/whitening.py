"""Whitening of embeddings by the leading components of their covariance.

An entry c becomes the whole number x = floor(1024 * c) + 100000.  One pass adds up the
rows and, exactly, their entries; a second adds up products of the centred entries
(centring comes first, as x is large against its spread); the covariance, one row a
dimension, is all that reaches the driver, where ``feast`` finds its components.
A third pass measures the covariance of the whitened rows against the identity.  Each
pass is a scan in Arrow tasks that send one small row for each pair of dimensions, which
Spark adds up; nothing is shuffled but those.

A vector that is null, or has a null or non-finite entry or one whose x is no long, is
no vector, and its row is dropped.  The dimension is the one that most rows have (of equal
counts the larger); a row of another length is dropped too.

Defined results: components whose eigenvalue is zero within rounding do not exist, so
equal vectors, one vector or none give no rows; a null id and repeated rows count
and pass through one for one; other columns pass through untouched, but a column
named like one of the results is replaced by it; an empty table gives an empty result.
``deviation`` is exact up to 38 digits and null beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .feast import largest

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries that are handled at once.
PIECE = 1 << 18
#: Whole numbers up to here are multiplied and added as longs, larger ones as Python's.
_ROOM = 2**62


@dataclass(frozen=True)
class Model:
    """What a fit found: rows, exact sums by dimension, components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


def _pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a column of vectors, some at a time."""
    lengths = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    group = np.cumsum(lengths) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, column.slice(a, b - a)


def _whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a vector, length, x of all entries) of rows."""
    lengths = np.asarray(pc.list_value_length(vectors).fill_null(0), np.int64)
    entries = np.asarray(pc.list_flatten(vectors).cast(pa.float64()).fill_null(np.nan))
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * entries)
    bad = ~(np.abs(x) < _ROOM)
    good = np.asarray(vectors.is_valid()) & (lengths > 0)
    good[np.repeat(np.arange(len(lengths)), lengths)[bad]] = False
    x[bad] = 0
    return good, lengths, x.astype(np.int64) + SHIFT


def _of_dimension(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are vectors of dimension d, their x)."""
    good, lengths, x = _whole(vectors)
    good &= lengths == d
    return np.flatnonzero(good), x[np.repeat(good, lengths)].reshape(-1, d)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) >= _ROOM:
        x = x.astype(object)
    return n * x - np.array(sums, dtype=x.dtype)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _squares(y: np.ndarray) -> list[Decimal | None]:
    """Exact sums of squares of rows of whole numbers."""
    if y.dtype == object or y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 >= _ROOM:
        y = y.astype(object)
    return [Decimal(int(v)) if int(v) < 10**38 else None for v in (y * y).sum(axis=1)]


def totals(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums by dimension of a table with one column ``vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, part in _pieces(batch.column(0)):
                good, lengths, x = _whole(part)
                for d in np.unique(lengths[good]).tolist():
                    rows = good & (lengths == d)
                    own = x[np.repeat(rows, lengths)].reshape(-1, d)
                    if len(own) * int(np.abs(own).max()) >= _ROOM:
                        own = own.astype(object)
                    n, sums = found.get(d, (0, np.zeros(d, object)))
                    found[d] = [n + len(own), sums + own.sum(axis=0)]
        for d, (n, sums) in found.items():
            one = [pa.array([v] * d, pa.int64()) for v in (d, n)]
            yield pa.RecordBatch.from_arrays([one[0], pa.array(range(d), pa.int32()), one[1], pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], ["d", "i", "n", "total"])

    parts = vectors.mapInArrow(run, "d long, i int, n long, total decimal(38,0)")
    sizes = parts.where("i = 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return 0, ()
    rows = parts.where(F.col("d") == sizes.d).groupBy("i").agg(F.sum("total").alias("total")).collect()  # one row a dimension
    return sizes.n, tuple(int(r.total) for r in sorted(rows, key=lambda r: r.i))


def _products(vectors: DataFrame, d: int, of) -> np.ndarray:
    """The sum of outer products of the rows that ``of`` makes of each piece's x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, part in _pieces(batch.column(0)):
                rows = of(_of_dimension(part, d)[1])
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    cells = vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # one row a pair of dimensions
    size = max((c.j for c in cells), default=-1) + 1
    out = np.zeros((size, size))
    for c in cells:
        out[c.i, c.j] = out[c.j, c.i] = c.v
    return out


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model:
    """The components of all vectors of a column."""
    vectors = rows.select(F.col(f"`{column}`").alias("vector"))
    n, sums = totals(vectors)
    d = len(sums)
    if not n:
        return Model(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    covariance = _products(vectors, d, lambda x: _centred(x, n, sums)) / n
    values, axes = largest(covariance, components)
    weights = axes / np.sqrt(values)
    error = 0.0
    if len(values):
        # the centred rows' projections have mean zero, so their products need no further centring
        found = _products(vectors, d, lambda x: _centred(x, n, sums) @ weights) / n
        error = float(np.abs(found - np.eye(len(values))).max())
    return Model(n, sums, values, axes, float(np.trace(covariance)), error)


def whitened(rows: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """The rows that have a vector: all their columns, then deviation and whitened (one entry a component); no shuffle."""
    n, sums, d = model.n, model.sums, len(model.sums)
    names = ("deviation", "whitened")
    kept = [f.name for f in rows.schema if f.name.lower() not in names]
    # the caller's columns travel as one, so that no name of theirs meets one of ours
    given = rows.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in kept)).alias("row"), F.col(f"`{column}`").alias("vector"))
    weights = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in _pieces(batch.column("vector")) if d else ():
                at, x = _of_dimension(part, d)
                y = _deviations(x, n, sums)
                white = (y / n).astype(np.float64) @ weights
                bounds = pa.array(np.arange(len(at) + 1, dtype=np.int32) * white.shape[1])
                lists = pa.ListArray.from_arrays(bounds, pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at + first)), pa.array(_squares(y), pa.decimal128(38, 0)), lists], ["row", *names])

    schema = T.StructType([given.schema["row"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return given.mapInArrow(run, schema).select(*(F.col("row").getField(c).alias(c) for c in kept), *names)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on every component, with the fit's figures; a deviation that is no long is null."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(rows)
    each = whitened(rows, model).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    return each.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
