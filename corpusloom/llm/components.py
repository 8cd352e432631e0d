"""Connected components of a graph of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, settled


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node, component: for each node of a link the smallest node that it reaches.

    Each round every node takes the smallest label among its own, its neighbours' and its label's label;
    labels and neighbours are aggregated before they meet, so a node with many links costs a row for each
    link and no more. Rounds are about the logarithm of the longest path; each is written to the
    shared folder."""
    edges = settled(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settled(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        far = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        step = (
            labels.join(near, F.col("node") == F.col("a"))
            .join(far, F.col("component") == F.col("at"))
            .select("node", F.least("component", "near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved"))
        )
        step = settled(step, "labels")
        done_with(labels)
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            done_with(edges)
            return labels
