"""Connected components by alternating large and small stars.

Every round halves the distance to a component's smallest node, or better; the
edges are written to the shared folder after each, so that a lost executor
costs one round; so are the least neighbours, which gives the joins shuffles of
their own on both sides, so that the edges of one large hub can be split.
Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = staged(least, "least")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and component of every row of ``nodes`` (node, rank; no node twice).

    ``links`` has columns a and b, in any order and with repeats. A component
    is named by the smallest rank among its nodes; null ranks name it only if
    it has no other. A node without links is a component of its own; links with
    a null end are none; empty tables give no rows.
    """
    edges = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, now = None, _mark(edges)
    while now != before and now[0]:
        edges = staged(_small(_large(edges)), "edges")
        before, now = now, _mark(edges)
    rooted = nodes.join(edges, nodes["node"] == edges["u"], "left").select("node", "rank", F.coalesce("v", "node").alias("root"))
    # written, so that the nodes of one large component are not held where its name was found, and can be split
    named = staged(rooted.groupBy("root").agg(F.min("rank").alias("component")), "named")
    return rooted.join(named, "root").select("node", "component")
