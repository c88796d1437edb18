"""Connected components by repeated contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import written


def _rooted(step: DataFrame) -> DataFrame:
    """Pointers (node, to) of trees followed to their roots, by doubling: as many joins as the logarithm of the depth, and one."""
    while True:
        after = step.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = written(step.join(after, "to").select("node", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")), "map")
        if step.where("moved").isEmpty():
            return step.select("node", "to")
        step = step.select("node", "to")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is one node's id, the same for all that are linked.

    Each round points every node to its least neighbour if that is less than itself. A node that is less than its neighbours
    stays a root if others point to it, else it points to its least neighbour as well, which has pointed elsewhere:
    so there is no cycle, and every tree has two nodes at least. The trees contract to their roots, and the nodes that
    still have edges at least halve: n nodes take at most log2(n) rounds, whatever their ids, each of at most log2(n) + 1
    joins. The least neighbour is a partially aggregated minimum and the joins may be split on skew, so a star with
    any number of leaves is no obstacle. Null ends and self-loops are dropped; an empty table gives an empty result.
    """
    links = written(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    maps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        low = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "low")
        led = low.where("least < node").select(F.col("least").alias("node"), F.lit(True).alias("led")).distinct()
        hooked = low.join(led, "node", "left").select("node", F.when((F.col("least") > F.col("node")) & F.col("led").isNotNull(), F.col("node")).otherwise(F.col("least")).alias("to"))
        step = _rooted(hooked)
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("a2")), step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = links.join(left, "a").join(right, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        links = written(moved.distinct(), "edges")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", F.col("to").alias("component"))
    for step in maps[1:]:
        later = step.select(F.col("node").alias("component"), "to")
        out = out.join(later, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(out, "components")
