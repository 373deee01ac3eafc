"""Connected components of a graph of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); component is the smallest node reachable.

    Each round links every larger neighbour to the smallest one seen (large star), then every smaller
    neighbour (small star), until nothing changes: the number of rounds follows the logarithm of the size.
    Minima are partial aggregates, neighbour lists are never gathered, and each round is written to the
    shared folder. Null ends and self-links count for nothing; no links, no rows.
    """
    both = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stage(both, "links"), None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        if not mark[0]:
            break
        # large star: neighbours larger than u go to the smallest of u and its neighbours
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.filter(F.col("v") > F.col("u")).join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "small")
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def extend_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """Staged components after new ``links`` (a, b): only the components that they join are worked on."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(component, "node", "left_anti")
    known = stage(component.unionByName(ends.withColumn("component", F.col("node"))), "known")
    label = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = links.join(label("a"), "a").join(label("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    merged = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return stage(known.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "components")
