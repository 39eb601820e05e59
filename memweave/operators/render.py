"""Subgraphs as text: DOT and Markdown lines, with the place of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memweave.operators.traverse import Subgraph, labels
from memweave.schema import CHUNK, LOG

CHUNK_SNIPPET = 800


def _line(df: DataFrame, part: int, order: list, text) -> DataFrame:
    return df.select(F.struct(F.lit(part).alias("part"), F.concat_ws("\x00", *order).alias("key")).alias("pos"), text.alias("line"))


def dot(graph: Subgraph) -> DataFrame:
    """``(pos, line)`` of a DOT digraph, without log nodes."""
    spark = graph.nodes.sparkSession
    nodes = graph.nodes.where(F.col("node_type") != LOG)
    quoted = lambda c: F.regexp_replace(F.substring(c, 1, 40), r'(["\\])', r"\\$1")
    ends = spark.createDataFrame([(0, "digraph memory {"), (3, "}")], "part int, line string").select(F.struct("part", F.lit("").alias("key")).alias("pos"), "line")
    of_nodes = _line(nodes, 1, ["uuid"], F.format_string('  "%s" [label="%s"];', "uuid", quoted("content")))
    of_edges = _line(graph.edges, 2, ["uuid"], F.format_string('  "%s" -> "%s" [label="%s"];', "subject_uuid", "object_uuid", "predicate"))
    return ends.unionByName(of_nodes).unionByName(of_edges)


def markdown(graph: Subgraph, seeds: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(pos, line)``: nodes with their source snippets, labelled edges, then chunks.

    ``sources`` has ``(entity_uuid, pos, snippet)``.
    """
    spark = graph.nodes.sparkSession
    heads = spark.createDataFrame([(0, "## Knowledge Graph"), (2, "## Relationships")], "part int, line string").select(F.struct("part", F.lit("").alias("key")).alias("pos"), "line")
    marked = graph.nodes.where(~F.col("node_type").isin(LOG, CHUNK)).join(seeds.select("uuid").distinct().withColumn("seed", F.lit(" [SEED]")), "uuid", "left")
    meta = F.col("metadata") if "metadata" in graph.nodes.columns else F.lit("{}")
    text = F.format_string("- **%s** `%s`%s: %s (metadata=%s)", "node_type", F.substring("uuid", 1, 8), F.coalesce("seed", F.lit("")), "content", F.coalesce(meta, F.lit("{}")))
    out = heads.unionByName(_line(marked, 1, [F.col("uuid"), F.lit("0")], text))
    if sources is not None:
        shown = sources.join(marked.select("uuid"), F.col("entity_uuid") == F.col("uuid"), "left_semi")
        out = out.unionByName(_line(shown, 1, [F.col("entity_uuid"), F.format_string("1%08d", F.col("pos").cast("long"))], F.format_string('  [source] "%s"', "snippet")))
    named = labels(graph.edges, graph.nodes)
    out = out.unionByName(_line(named, 3, [F.col("uuid")], F.format_string("- %s --[%s]--> %s", "subject_label", "predicate", "object_label")))
    chunks = graph.nodes.where(F.col("node_type") == CHUNK)
    if "metadata" in graph.nodes.columns:
        name, at = F.get_json_object("metadata", "$.filename"), F.get_json_object("metadata", "$.chunk_index")
        head = F.when(F.coalesce(name, F.lit("")) != "", F.format_string("[%s chunk %s]", name, F.coalesce(at, F.lit("")))).otherwise(F.lit("[chunk]"))
        out = out.unionByName(_line(chunks, 5, [F.col("uuid")], F.format_string('%s "%s"', head, F.substring("content", 1, CHUNK_SNIPPET))))
        title = chunks.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.struct(F.lit(4).alias("part"), F.lit("").alias("key")).alias("pos"), F.lit("## Source Chunks").alias("line"))
        out = out.unionByName(title)
    return out
