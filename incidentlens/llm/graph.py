"""Connected components of links between rows, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node in ``links`` (columns ``a``, ``b``).

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so a chain of
    ``n`` nodes needs about log n rounds. Labels are written every round; minima combine before the shuffle.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near")).select(
        "node", F.least("node", "_near").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("_near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "_near").alias("_step"))
        jump = labels.select(F.col("node").alias("_step"), F.col("component").alias("_jump"))
        moved = materialize(stepped.join(jump, "_step", "left").select(
            "node", F.least("_step", F.coalesce("_jump", "_step")).alias("component"),
            (F.least("_step", F.coalesce("_jump", "_step")) < F.col("component")).alias("_moved"),
        ))
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return labels
