"""Connected components of a table of links, by minimum labels and pointer jumping.

Every round is written to the shared folder. Labels are joined to links as plain tables, so that adaptive
execution can split a hot node, and minima are aggregated map-side. No links ever reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carlake.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node reachable."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both, "links")
    labels = written(
        edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels"
    )
    total = _total(labels)
    while total is not None:
        seen = edges.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        least = written(labels.union(seen).groupBy("node").agg(F.min("label").alias("label")), "labels")
        further = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(least.join(further, "label").select("node", F.col("further").alias("label")), "labels")
        before, total = total, _total(labels)
        if total == before:  # labels only ever fall, so an equal sum is an equal table
            break
    return labels


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
