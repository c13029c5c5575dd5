"""Connected components of a link table, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)`` for every node that has a link; ``label`` is the
    smallest node of its component.

    Each round gives a node the smallest label among its own and its
    neighbours' and then follows that label's own label, so labels travel
    twice as far each time; it ends when a round changes nothing.  A hub may
    hold any share of the links: its minimum is a partial aggregation.
    Every round is written to the shared checkpoint folder."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    edges = materialise(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), F.col("label").alias("other")), "v") \
            .groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        far = step.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = materialise(step.join(far, "label").select(
            "node", F.least("label", "beyond").alias("label"),
            (F.least("label", "beyond") != F.col("old")).alias("changed")))
        if labels.where("changed").isEmpty():
            return labels.select("node", "label")
