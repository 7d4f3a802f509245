"""Connected components by alternating large-star and small-star steps.

Edges live in tables of the shared folder; each step links nodes to the smallest
neighbour, so the steps needed grow with the logarithm of the longest path. A
node with very many neighbours costs an aggregation and a join, never a group in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that ``edges`` (columns a, b) name.

    Self-links name a node without linking it; nulls are ignored. Each step marks
    the edges that it made anew; the first step without any ends the loop.
    """
    start = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(start.withColumn("c", F.lit(True)), "cc")
    while not now.where("c").isEmpty():
        # Large star: larger neighbours go to the smallest neighbour.
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("c"))
        alone = now.where("u = v").select("u", "v", F.lit(False).alias("c"))
        large = large.unionAll(alone).groupBy("u", "v").agg(F.max("c").alias("c"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.max("c").alias("c"))
        small = large.where("u <> v").join(down.select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("c"))
        after = small.unionAll(down.select("u", F.col("m").alias("v"), "c")).groupBy("u", "v").agg(F.max("c").alias("c"))
        after = materialize(after, "cc")
        discard(now)
        now = after
    # Each node now has one edge, to the smallest node; that one has none of its own.
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))


def merged_components(first: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) after further links (a, b): only the components that these touch are worked on."""
    a = first.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    own = more.join(a, "a", "left").join(b, "b", "left")
    links = own.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = materialize(connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("root")), "cc-roots")
    known = first.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    new = roots.join(first.select(F.col("node").alias("component")), "component", "left_anti")
    return known.unionByName(new.select(F.col("component").alias("node"), F.col("root").alias("component")))
