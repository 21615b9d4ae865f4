"""Bounded labelled samples and small numpy models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a fit reads.
SAMPLE = 20_000


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int = SAMPLE) -> DataFrame:
    """(text, y) of about ``most`` labelled documents at most, none of them held out.

    The labels are drawn by a hash of their id before the join, so the side that
    is broadcast has a fixed bound.  Of several labels of one id the largest
    counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out("doc_id", parts, part) & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    count = known.count()
    if count > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / count)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(x)) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
