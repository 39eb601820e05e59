"""Decayed vector search over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memweave.functions import scoring
from memweave.schema import HALF_LIFE_DAYS, LOG


def observed(df: DataFrame) -> Column:
    """How often a row was observed: ``n_obs`` where the table has it, else the journal's length."""
    return F.coalesce(F.col("n_obs"), F.lit(0)) if "n_obs" in df.columns else F.coalesce(F.size("journal_entry_ids"), F.lit(0))


def knn(df: DataFrame, query: Column, k: int) -> DataFrame:
    """The ``k`` nearest rows with ``distance``; rows without a vector never appear. Exact."""
    scored = df.where("embedding IS NOT NULL").withColumn("distance", scoring.cosine_distance(F.col("embedding"), query))
    return scored.orderBy("distance", "uuid").limit(k)


def in_scope(df: DataFrame, user_id: str, domain: str | None = None, node_types: list[str] | None = None, kinds: bool = True) -> DataFrame:
    out = df.where(F.col("user_id") == user_id)
    if domain:
        out = out.where(F.col("domain") == domain)
    if kinds:
        out = out.where(F.col("node_type").isin(node_types) if node_types else F.col("node_type") != LOG)
    return out


def _ranked(df: DataFrame, query: Column, limit: int, life: Column, now: str, least_weight: float) -> DataFrame:
    pool = knn(df, query, scoring.pool_size(limit))
    created = F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp")
    updated = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp")
    age = scoring.age_days(updated, created, now)
    out = pool.withColumn("effective", scoring.effective_distance(F.col("distance"), age, life, observed(df))).where("weight > 0")
    if least_weight > 0:
        out = out.where(F.col("weight") >= least_weight)
    return out.orderBy("effective", "uuid").limit(limit)


def search_nodes(
    nodes: DataFrame, query: Column, now: str, user_id: str = "global", domain: str | None = None, node_types: list[str] | None = None, limit: int = 10, min_significance: float = 0.0
) -> DataFrame:
    """The pool of nearest nodes, re-ranked by decay and reinforcement, then filtered and cut."""
    return _ranked(in_scope(nodes, user_id, domain, node_types), query, limit, scoring.half_life(F.col("node_type")), now, min_significance)


def search_edges(edges: DataFrame, query: Column, now: str, user_id: str = "global", domain: str | None = None, limit: int = 10, min_significance: float = 0.0) -> DataFrame:
    return _ranked(in_scope(edges, user_id, domain, kinds=False), query, limit, F.lit(HALF_LIFE_DAYS["edge"]), now, min_significance)


def search(nodes: DataFrame, edges: DataFrame, query: Column, now: str, **how) -> tuple[DataFrame, DataFrame]:
    """Both sides, ranked apart and never fused."""
    edge_how = {k: v for k, v in how.items() if k != "node_types"}
    return search_nodes(nodes, query, now, **how), search_edges(edges, query, now, **edge_how)


def counted(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Both result lists as ``(kind, uuid, effective)``, each row with the ``count`` of all."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "uuid", "effective")
    both = one(found, "node").unionByName(one(facts, "edge"))
    return both.crossJoin(both.agg(F.count(F.lit(1)).alias("count")))  # one row
