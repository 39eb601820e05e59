"""Connected components by alternating large-star and small-star.

Links stay in tables: each half-round is an aggregation (with partial sums, so a hub
costs one row a task), a join that Spark may split where a hub is hot, and a written
table that cuts lineage. Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memweave.runtime import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (u, v)``: the smallest node that it reaches.

    Self-links, repeated links and nulls are ignored. Nodes without links are not listed.
    Ends when a whole round changes nothing, which is when every node hangs on its
    component's smallest one.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    before = _checksum(edges)
    while before[0]:
        now = materialize(_small_star(_large_star(edges).distinct()).distinct(), "star")
        after = _checksum(now)
        release(edges)
        edges = now
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
