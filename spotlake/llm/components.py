"""Connected components of a graph given as links, by hooking and contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.common import cut


def smallest_reachable(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root): for each node of a link the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour, twice over, and replaces the links by links between the hooks;
    links within one hook vanish. Labels only fall and stay inside their component, so when no link is left each
    component has one label, its smallest node. Rounds grow about with the logarithm of a component's
    width where the order of nodes is as good as random, as that of hashes is; along a chain of rising nodes they grow with its length. Every round is
    written to the shared folder. Nulls aren't nodes: such links are dropped. No links: an empty table.
    """
    both = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label: DataFrame | None = None
    while not both.isEmpty():
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("hook"))
        onward = hook.select(F.col("node").alias("hook"), F.col("hook").alias("next"))
        hook = cut(hook.join(onward, "hook").select("node", F.col("next").alias("hook")))
        if label is None:
            label = hook.select("node", F.col("hook").alias("root"))
        else:
            moved = hook.select(F.col("node").alias("root"), "hook")
            label = cut(label.join(moved, "root", "left").select("node", F.coalesce("hook", "root").alias("root")))
        ends = hook.select(F.col("node").alias("a"), F.col("hook").alias("x"))
        both = both.join(ends, "a").select(F.col("x").alias("a"), "b")
        ends = hook.select(F.col("node").alias("b"), F.col("hook").alias("y"))
        both = cut(both.join(ends, "b").select("a", F.col("y").alias("b")).where("a <> b").distinct())
    if label is None:
        label = both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label
