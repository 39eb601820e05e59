"""Bounded breadth-first expansion with similarity pruning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memweave.functions import scoring
from memweave.functions.ids import self_id
from memweave.operators.search import observed
from memweave.runtime import materialize
from memweave.schema import LOG

#: Edges of a node and direction that are looked at, by id. Dead edges take up places.
NEIGHBOR_EDGES = 50


@dataclass
class Subgraph:
    nodes: DataFrame
    edges: DataFrame


#: Up to so many keys go into a scan as values, which prunes the buckets it reads; more are joined.
MOST_KEYS = 10_000


@dataclass
class ByKey:
    """A table that is not stored: ``pick(column, keys)`` computes the rows of a few keys alone, ``table`` is all of it."""

    table: DataFrame
    pick: Callable[[str, list[str]], DataFrame]


@dataclass
class GraphView:
    """A graph whose tables are computed. One request asks for the rows of each hop's keys, where a store would write all of them first."""

    nodes: ByKey
    edges: ByKey

    @property
    def edges_out(self) -> ByKey:
        return self.edges

    @property
    def edges_in(self) -> ByKey:
        return self.edges


class GraphStore:
    """Nodes bucketed by id, and edges twice, bucketed by either end: a hop reads the buckets of its frontier alone."""

    def __init__(self, spark: SparkSession, name: str):
        self.nodes, self.edges_out, self.edges_in = (spark.table(f"{name}_{x}") for x in ("nodes", "out", "in"))

    @classmethod
    def write(cls, name: str, path: str, nodes: DataFrame | Callable[[DataFrame], DataFrame], edges: DataFrame, buckets: int = 32) -> GraphStore:
        """``nodes`` may be a function of the stored edges. Edges are computed once; their second copy is made of the first."""
        spark = edges.sparkSession
        for part, key in (("out", "subject_uuid"), ("in", "object_uuid"), ("nodes", "uuid")):
            df = edges if part == "out" else spark.table(f"{name}_out")
            df = df if part != "nodes" else nodes(df) if callable(nodes) else nodes
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
            df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{part}").saveAsTable(f"{name}_{part}")
        return cls(spark, name)


def picked(df: DataFrame | ByKey, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``keys (uuid)``: by values in the scan, or by a semi join where there are many."""
    some = [r["uuid"] for r in keys.limit(MOST_KEYS + 1).collect()]
    if len(some) <= MOST_KEYS:
        return df.pick(column, some) if isinstance(df, ByKey) else df.where(F.col(column).isin(some))
    df = df.table if isinstance(df, ByKey) else df
    return df.join(keys.select(F.col("uuid").alias("__key")), F.col(column) == F.col("__key"), "left_semi")


def incident_edges(edges: DataFrame | GraphStore | GraphView, frontier: DataFrame, user_id: str, cap: int = NEIGHBOR_EDGES) -> DataFrame:
    """Edges of a user that touch ``frontier (uuid)``, with the touched end ``at`` and the ``other``.

    The two directions are two scans by keys, each capped per node; a condition with OR would
    be a nested loop.
    """

    def one_way(table: DataFrame | ByKey, near: str, far: str) -> DataFrame:
        met = picked(table, near, frontier.select("uuid").distinct()).where(F.col("user_id") == user_id).withColumn("at", F.col(near))
        rank = F.row_number().over(Window.partitionBy("at").orderBy("uuid"))
        return met.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank").withColumn("other", F.col(far))

    out, into = (edges.edges_out, edges.edges_in) if isinstance(edges, GraphStore | GraphView) else (edges, edges)
    return one_way(out, "subject_uuid", "object_uuid").unionByName(one_way(into, "object_uuid", "subject_uuid"))


def passes_source(source: str | None) -> Column:
    """No source passes every filter."""
    return F.lit(True) if source is None else F.col("source").isNull() | (F.col("source") == source)


def prune(nodes: DataFrame, query: Column | None, k: int) -> DataFrame:
    """The ``k`` best nodes by similarity to the query and share of the most observations."""
    n = observed(nodes)
    near = scoring.cosine(F.col("embedding"), query) if query is not None else F.lit(0.0)
    most = nodes.agg(F.max(n).alias("most"))  # one row
    scored = nodes.crossJoin(most).withColumn("score", scoring.frontier_score(near, n, F.col("most")))
    return scored.orderBy(F.desc("score"), "uuid").limit(k).drop("score", "most")


def expand(
    nodes: DataFrame | ByKey,
    edges: DataFrame | GraphStore | GraphView,
    seeds: DataFrame,
    query: Column | None = None,
    hops: int = 2,
    limit_per_hop: int = 20,
    user_id: str = "global",
    self_floor: int = 40,
    source: str | None = None,
) -> Subgraph:
    """Expand ``seeds (uuid)`` hop by hop.

    A dead edge is not returned but still leads on; a node has one chance to be kept; log
    nodes are returned but never expanded; the source filter spares seeds and logs. Edges
    may point to nodes that are not returned. Loop state is small: at most
    ``limit_per_hop + self_floor`` frontier nodes and their capped edges a hop, each written
    to the shared folder so that plans stay short.
    """
    alive = lambda keys: picked(nodes, "uuid", keys).where("weight > 0")
    found = materialize(seeds.select("uuid").distinct(), "discovered")
    start = materialize(alive(found).where(F.col("node_type") != LOG), "seeds")
    out_nodes, out_edges = start, None
    stored = edges.edges_out if isinstance(edges, GraphStore | GraphView) else edges
    stored = stored.table if isinstance(stored, ByKey) else stored
    columns = stored.columns
    frontier = start.where(passes_source(source)).select("uuid")
    me = self_id(F.lit(user_id))
    for hop in range(hops):
        met = materialize(incident_edges(edges, frontier, user_id), "incident")
        live = met.where("weight > 0").select(*columns)
        out_edges = live if out_edges is None else out_edges.unionByName(live)
        reached = met.select("at", "other").join(found.withColumnRenamed("uuid", "other"), "other", "left_anti")
        reached = materialize(reached, "reached")
        new = reached.select(F.col("other").alias("uuid")).distinct()
        if reached.isEmpty():
            break
        found = found.unionByName(new)
        rows = materialize(alive(new), "rows")
        others = rows.where((F.col("node_type") != LOG) & passes_source(source if source else None))
        kept = prune(others, query, limit_per_hop)
        if hop == 0 and self_floor > 0:
            mine = reached.where(F.col("at") == me).select(F.col("other").alias("uuid")).distinct()
            kept = kept.unionByName(prune(others.join(mine, "uuid", "left_semi"), query, self_floor)).dropDuplicates(["uuid"])
        kept = materialize(kept, "kept")
        out_nodes = out_nodes.unionByName(rows.where(F.col("node_type") == LOG)).unionByName(kept)
        frontier = kept.select("uuid")
    return Subgraph(out_nodes, (out_edges if out_edges is not None else stored.limit(0)).dropDuplicates(["uuid"]))


def merge(base: Subgraph, extra: Subgraph) -> Subgraph:
    """Nodes of ``extra`` win by id; edges of ``base`` win by subject, predicate and object."""
    nodes = extra.nodes.unionByName(base.nodes.join(extra.nodes.select("uuid"), "uuid", "left_anti"))
    triple = ["subject_uuid", "predicate", "object_uuid"]
    fresh = extra.edges.join(base.edges.select(*triple), triple, "left_anti").groupBy(*triple).agg(F.min(F.struct(*[c for c in extra.edges.columns if c not in triple])).alias("r"))
    fresh = fresh.select(*triple, "r.*").select(*extra.edges.columns)
    return Subgraph(nodes, base.edges.unionByName(fresh))


def labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels of both ends: 40 characters of content, or 8 of the id where the node is not there."""
    of = lambda side: nodes.select(F.col("uuid").alias(f"{side}_uuid"), F.substring("content", 1, 40).alias(f"{side}_label"))
    out = edges.join(of("subject"), "subject_uuid", "left").join(of("object"), "object_uuid", "left")
    for side in ("subject", "object"):
        out = out.withColumn(f"{side}_label", F.coalesce(f"{side}_label", F.substring(f"{side}_uuid", 1, 8)))
    return out


def search_then_expand(nodes: DataFrame | ByKey, edges: DataFrame | GraphStore | GraphView, query: Column, now: str, limit: int = 10, hops: int = 2, limit_per_hop: int = 20, user_id: str = "global", facts: DataFrame | None = None) -> Subgraph:
    """All hits of a search, nodes and edges alike, as seeds. ``facts`` are the edges with vectors, where ``edges`` has none."""
    from memweave.operators.search import search

    if facts is None:
        facts = edges.edges_out if isinstance(edges, GraphStore | GraphView) else edges
        facts = facts.table if isinstance(facts, ByKey) else facts
    hits = search(nodes.table if isinstance(nodes, ByKey) else nodes, facts, query, now, limit=limit, user_id=user_id)
    seeds = hits[0].select("uuid").unionByName(hits[1].select("uuid"))
    return expand(nodes, edges, seeds, query, hops, limit_per_hop, user_id)
