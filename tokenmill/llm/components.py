"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """Smallest node of each node's component: node, component.

    ``links`` has columns a and b. Every round each node moves to its smallest neighbour, and on
    to that one's, and the links are contracted to the nodes that are left. A node with very many
    links costs no more than others: minima are taken before the shuffle, and joins with its rows
    can be split. No links give no rows.
    """
    edges = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        to = cut_lineage(to, "steps")
        far = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
        to = cut_lineage(to.join(far, "to").select("node", F.col("further").alias("to")), "steps")
        if label is None:
            label = to.select("node", F.col("to").alias("component"))
        else:
            moved = to.select(F.col("node").alias("component"), F.col("to").alias("moved"))
            label = cut_lineage(
                label.join(moved, "component", "left").select("node", F.coalesce("moved", "component").alias("component")), "labels"
            )
        at = lambda side: to.select(F.col("node").alias(side), F.col("to").alias(f"new_{side}"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("new_a <> new_b")
        edges = cut_lineage(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "links")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return label
