"""Connected components by alternating stars over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _nearest(links: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours, for each u; a node per row of ``links`` (u, v)."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _settled(links: DataFrame) -> bool:
    """Whether the links (u, v) are stars: no u has two links, and no u is a v."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    nodes = links.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return nodes.agg(F.coalesce(F.max(F.col("down") + F.least("up", "down")), F.lit(0))).first()[0] < 2


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, component (the smallest node that it reaches) for each node of a link.

    Rounds of two steps: each node's larger neighbours are linked to the smallest neighbour, then
    its smaller ones. Links turn into stars around the smallest nodes in a few rounds, mostly
    independent of how long the chains are; links that are such stars already take none. A round
    is written to the shared folder, so the plan stays short. Loops, repeats and nulls among the
    links are ignored. A node with many links is met by partial aggregates and by joins whose
    large partitions Spark can split.
    """
    clean = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    clean = staged(clean.where(F.col("u") != F.col("v")).distinct(), "links")
    for _ in range(rounds):
        if _settled(clean):
            break
        both = clean.unionAll(clean.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_nearest(both), "nearest")
        linked = both.join(large, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        linked = staged(linked, "large")
        small = staged(_nearest(linked), "nearest")
        moved = linked.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        clean = staged(moved.unionAll(small.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "small")
    else:
        raise RuntimeError("the components did not settle")
    roots = clean.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return clean.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
