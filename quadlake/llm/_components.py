"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm._common import stash, unstash


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or other) neighbours to its smallest one."""
    near = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # The minima are read back from a table, so that the join has two plain exchanges, which AQE can split, or a broadcast
    # of a side whose size is known.
    least = stash(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = near.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return stash(moved.filter(F.col("a") != F.col("b")).distinct(), "links")


def _settled(links: DataFrame) -> bool:
    """Every node links to one smaller node, which itself links to none."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of the links a - b, by alternating large and small stars until every
    component is one star around its smallest node. Nothing but that answer reaches the driver."""
    links = stash(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(links):
        after = _star(_star(links, True), False)
        unstash(links)
        links = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()
