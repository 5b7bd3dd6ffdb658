"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.scratch import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, label) for every end of links(a, b); label is the least node of the component.

    Each round every node takes the least label around it, then the label of that label. A node
    with very many links is a sum over partial sums. Rounds grow with the logarithm of the longest path.
    """
    edges = scratch.table(links.selectExpr("a as node", "b as other").unionByName(links.selectExpr("b as node", "a as other")), "edges")
    label = scratch.table(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "label")
    while True:
        near = edges.join(label.withColumnRenamed("node", "other").hint("shuffle_merge"), "other").select("node", "label")
        least = near.unionByName(label).groupBy("node").agg(F.min("label").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = least.join(jump.hint("shuffle_merge"), "label", "left").select("node", F.least("label", "next").alias("label"))
        now = scratch.table(now, "label")
        changed = now.alias("n").join(label.alias("o").hint("shuffle_merge"), "node").where("n.label <> o.label").limit(1).count()
        scratch.drop(label)
        label = now
        if not changed:
            scratch.drop(edges)
            return label
