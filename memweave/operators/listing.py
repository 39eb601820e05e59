"""Point lookups, listings and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memweave.operators import providers
from memweave.schema import LOG
from memweave.sources.vocabulary import Vocabulary

MOST = 500


def _check(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST} and offset 0 or more")


def by_uuid(nodes: DataFrame, uuid: str) -> DataFrame:
    return nodes.where(F.col("uuid") == uuid)


def entry_by_uuid(nodes: DataFrame, uuid: str) -> DataFrame:
    """Empty unless the node is a log."""
    return by_uuid(nodes, uuid).where(F.col("node_type") == LOG)


def by_uuids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``ids (uuid)``; missing ones drop out."""
    return nodes.join(ids.select("uuid").distinct(), "uuid", "left_semi")


def list_nodes(nodes: DataFrame, user_id: str = "global", node_type: str | None = None, domain: str | None = None, limit: int = 20, offset: int = 0, time: str = "created_at", global_order: bool = False) -> DataFrame:
    """A page. As a store does that sorts what it has fetched, the first ``limit + offset`` rows by id
    are sorted by time, rows without one first; ``global_order`` sorts all rows instead."""
    _check(limit, offset)
    out = nodes.where(F.col("user_id") == user_id)
    for name, value in (("node_type", node_type), ("domain", domain)):
        if value:
            out = out.where(F.col(name) == value)
    if not global_order:
        out = out.orderBy("uuid").limit(limit + offset)
    return out.orderBy(F.asc_nulls_first(time), "uuid").offset(offset).limit(limit)


def list_entries(nodes: DataFrame, user_id: str = "global", since: str | None = None, limit: int = 20, newest_first: bool = True, global_order: bool = False) -> DataFrame:
    """Logs of a user; the time filter comes after the first ``limit`` rows by id were taken."""
    _check(limit)
    out = nodes.where((F.col("user_id") == user_id) & (F.col("node_type") == LOG))
    if not global_order:
        out = out.orderBy("uuid").limit(limit)
    if since:
        out = out.where(F.col("created_at") >= F.lit(since).cast(dict(nodes.dtypes)["created_at"]))
    return out.orderBy(F.desc("created_at") if newest_first else F.asc("created_at"), "uuid").limit(limit)


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges")))  # one row each


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, name, n)``, the most frequent first."""
    one = lambda df, c, kind: counts(df, c).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    return one(nodes, "node_type", "node_type").unionByName(one(edges, "predicate", "predicate")).orderBy("kind", F.desc("n"), "name")


def vocabulary(stored: Vocabulary) -> DataFrame:
    """``(kind, name)`` of known node types and predicates, in alphabetical order."""
    return stored.read().orderBy("kind", "name")


def to_embed(nodes: DataFrame, limit: int) -> DataFrame:
    """Nodes to give a vector: of the first ``10 * limit`` by id, the first ``limit`` with text and without one."""
    _check(limit)
    some = nodes.orderBy("uuid").limit(10 * limit)
    return some.where("embedding IS NULL AND content <> ''").orderBy("uuid").limit(limit)


def backfill(nodes: DataFrame, limit: int, embed: Callable[[Column], Column] = providers.embed) -> DataFrame:
    """``nodes`` with vectors for those of ``to_embed``, and with ``filled`` for these."""
    made = to_embed(nodes, limit).select("uuid", embed(F.col("content")).alias("made"))
    out = nodes.join(made, "uuid", "left")
    return out.withColumn("embedding", F.coalesce("embedding", "made")).withColumn("filled", F.col("made").isNotNull()).drop("made")


def health(spark) -> DataFrame:
    return spark.createDataFrame([("ok",)], "status string")
