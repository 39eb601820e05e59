"""Source logs of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memweave.schema import LOG

PER_NODE, IN_TOTAL, SNIPPET = 2, 30, 250


def source_logs(entities: DataFrame, logs: DataFrame, per_node: int = PER_NODE, total: int | None = IN_TOTAL) -> DataFrame:
    """``(entity_uuid, log_uuid, pos, snippet)``, oldest first.

    ``entities`` has ``uuid``, ``journal_entry_ids`` and, where the order matters for the
    total, ``pos``. Each entity names its last ``per_node`` ids; of the distinct ids in
    order of naming, the first ``total`` are fetched (all for None).
    """
    tail = F.slice("journal_entry_ids", F.greatest(F.size("journal_entry_ids") - per_node + 1, F.lit(1)), F.lit(per_node))
    order = F.col("pos") if "pos" in entities.columns else F.col("uuid")
    who = entities.where(F.col("node_type") != LOG) if "node_type" in entities.columns else entities
    named = who.where(F.size("journal_entry_ids") > 0).select(F.col("uuid").alias("entity_uuid"), order.alias("entity_pos"), F.posexplode(tail).alias("pos", "log_uuid"))
    if total is not None:
        ids = named.groupBy("log_uuid").agg(F.min(F.struct("entity_pos", "pos")).alias("at")).orderBy("at", "log_uuid").limit(total).select("log_uuid")
        named = named.join(ids, "log_uuid", "left_semi")
    texts = logs.where(F.col("node_type") == LOG).select(F.col("uuid").alias("log_uuid"), F.substring("content", 1, SNIPPET).alias("snippet"))
    return named.join(texts, "log_uuid").select("entity_uuid", "log_uuid", (F.col("pos") + 1).alias("pos"), "snippet")


def newest_logs(logs: DataFrame, most: int = 50) -> DataFrame:
    """``(user_id, n, batch)``: the newest logs of each user as one text, for consolidation."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "uuid"))
    top = logs.where(F.col("node_type") == LOG).withColumn("rank", rank).where(F.col("rank") <= most)
    said = F.array_sort(F.collect_list(F.when(F.trim("content") != "", F.struct("rank", "content"))))
    return top.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), said.alias("said")).select("user_id", "n", F.array_join(F.transform("said", lambda x: x["content"]), "\n\n---\n\n").alias("batch"))
