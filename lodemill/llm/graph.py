"""Connected components of a table of links, with no link on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import Shared


def components(links: DataFrame, shared: Shared, name: str, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``comp``, the smallest node that it reaches, for every node with a link.

    Labels fall to the smallest among the neighbours and then to the label's own label, until
    none changes; each round's labels are written, so that a lost executor costs one round, and
    replace those of the round before.
    """
    both = links.select(F.col(left).alias("x"), F.col(right).alias("y")).unionByName(links.select(F.col(right).alias("x"), F.col(left).alias("y")))
    edges = shared.table(both.where("x <> y").distinct(), f"{name}-edges")
    labels = shared.table(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels.node == near.x).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("at"), F.col("comp").alias("up"))
        new = low.join(up, low.low == up.at, "left").select("node", "old", F.least("low", F.coalesce("up", "low")).alias("comp"))
        written = shared.table(new, f"{name}-{k}")
        changed = written.where("comp <> old").limit(1).count()
        shared.drop(f"{name}-{k - 1}")
        labels = written.select("node", "comp")
        if not changed:
            shared.drop(f"{name}-edges")
            return labels
