"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to one row per linked node: ``node`` and ``root``, its component's least node.

    Each round hooks every node to its least neighbour, shortens the chains by pointer
    jumping and contracts the links to the roots, so rounds grow with the logarithm of the
    component size.  All of it is joins and aggregates that combine before they shuffle.
    Self-links and repeated links change nothing; no links give an empty table.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        parents = materialize(hooks.select("node", F.least("node", "b").alias("root")), "parents")
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = materialize(
                parents.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")),
                "parents",
            )
            done = jumped.where("moved").isEmpty()
            discard(parents)
            parents = jumped
            if done:
                break
        roots = parents.select("node", "root")
        left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        rest = links.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        rest = materialize(rest.distinct(), "links")
        if labels is None:
            labels = roots
        else:
            tops = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = labels.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            labels = materialize(labels, "labels")
        discard(links)
        links = rest
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
