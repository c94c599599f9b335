"""Connected components of a link table, by rounds of hooking to the smallest neighbour and halving the way to the root."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from smeltery.session import durable


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every row of ``nodes`` (node); ``links`` has a and b.

    Every round takes for each component the smallest component it is linked to and then follows these pointers
    to their roots; links inside a component leave the table. Rounds grow with the logarithm of the longest way,
    each is stored, and one number a round reaches the driver.
    """
    found = durable(nodes.select("node").distinct().select("node", F.col("node").alias("component")))
    open_links = durable(links.where("a <> b").select("a", "b").distinct())
    while not open_links.isEmpty():
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _roots(both.groupBy("a").agg(F.min("b").alias("least")).where("least < a"))
        joined = found.join(roots.select(F.col("a").alias("component"), "root"), "component", "left")
        found = durable(joined.select("node", F.coalesce("root", "component").alias("component")))
        ends = [roots.select(F.col("a").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
        moved = open_links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        open_links = durable(moved.where("a <> b").distinct())
    return found


def _roots(hooks: DataFrame) -> DataFrame:
    """a, root: where the pointers a -> least end; a pointer always goes to a smaller node, so there is no circle."""
    ways = hooks.select("a", F.col("least").alias("root"))
    while True:
        ways = durable(ways)
        on = ways.select(F.col("a").alias("root"), F.col("root").alias("further"))
        longer = ways.join(on, "root", "left")
        if longer.where("further IS NOT NULL").isEmpty():
            return ways
        ways = longer.select("a", F.coalesce("further", "root").alias("root"))
