"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, saved


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of (a, b) links.

    Every round takes the smallest label among the neighbours and then that
    label's own label, so rounds grow with the logarithm of a component's
    diameter.  Each round is a written table, which cuts the lineage.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = saved(both.distinct(), "edges")
    labels = saved(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("id").alias("over"), F.col("component").alias("top"))
        moved = step.join(up, step.component == up.over).select("id", "old", F.least("component", "top").alias("component"))
        new = saved(moved, "labels")
        drop(labels)
        labels = new.select("id", "component")
        if not new.where("old <> component").limit(1).count():
            drop(edges)
            return labels
