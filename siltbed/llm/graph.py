"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import cut


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long), and of ``start`` if given.

    A component is named by its smallest node. ``start`` (node, component) holds components that are known already.
    Each round takes the least label among a node's neighbours and then that label's own label; rounds go on until
    no label changes, about as many as the logarithm of the longest path. Labels are written after each round.
    """
    if start is not None:  # components become nodes
        a, b = (start.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        links = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    while True:
        labels = cut(labels, "labels")
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = cut(near.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "step")
        changed = new.where("old != component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            break
    if start is not None:
        now = labels.select(F.col("node").alias("component"), F.col("component").alias("now"))
        moved = start.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
        labels = labels.join(start, "node", "left_anti").unionByName(moved)
    return labels
