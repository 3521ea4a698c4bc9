"""Connected components of link tables by alternating star contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved

#: Links up to which they are one partition, so that a round has no exchanges and hardly any files.
FEW = 1 << 17


def _stars(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    links = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = links.coalesce(1) if few else links
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # written, so that the join is a plain one of which Spark can split a hub's side
    least = least if few else saved(least)
    met = links.join(least, "a")
    out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return (out.coalesce(1) if few else out).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for every node that has a link; label: the smallest node that can be reached.

    edges: columns a and b of one ordered type; loops, repeats and nulls are ignored. Each round joins every link with
    the smallest neighbour of one end (partial aggregates, so that a hub's links are never gathered in one group) and
    writes the contracted links to the checkpoint folder; rounds grow with the logarithm of the longest path.
    """
    edges = saved(edges.select("a", "b").where("a <> b").distinct())
    # bit sums of what is there: equal before and after a round only once every link leads to its smallest node
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        few = before[0] <= FEW
        edges = saved(_stars(_stars(edges, True, few), False, few))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
