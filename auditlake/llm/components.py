"""Connected components of an edge table, with minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its least node.

    Each round takes the least label of all neighbours, combined before the shuffle, and then the label
    of that label, so chains shorten by half. Rounds end when nothing changes. A node with very many
    neighbours is a hot join key on one side only, which Spark splits. Every round is a table in the
    shared folder: nothing is gathered on the driver but the number of changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        heard = (
            both.join(labels.withColumnRenamed("a", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("heard"))
        )
        lower = labels.join(heard, "a").select("a", F.least("label", "heard").alias("next"), "label")
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("jumped"))
        joined = materialize(
            lower.join(jump, "next", "left").select(
                "a", F.least("next", F.coalesce("jumped", "next")).alias("next"), "label"
            )
        )
        changed = joined.where(F.col("next") != F.col("label")).limit(1).count()
        labels = joined.select("a", F.col("next").alias("label"))
        release(edges.sparkSession)
        if not changed:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
