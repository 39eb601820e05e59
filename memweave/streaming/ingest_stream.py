"""Incremental ingest and consolidation: files of entries and trigger files, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memweave.operators import ingest as stages
from memweave.operators import providers
from memweave.runtime import materialize, scratch
from memweave.sources import changelog
from memweave.sources.changelog import ChangeLog, Sequence, tombstones
from memweave.sources.keyed import KeyedLog
from memweave.sources.vocabulary import Vocabulary

ENTRIES = "entry_id string, text string, user_id string, domain string, source string, at timestamp"
RUNS = "user_id string, at timestamp"
NODE_COLUMNS = ["uuid", "node_type", "content", "domain", "source", "user_id", "created_at", "updated_at", "weight", "metadata", "name_key", "journal_entry_ids", "embedding"]
EDGE_COLUMNS = ["uuid", "subject_uuid", "predicate", "object_uuid", "content", "user_id", "created_at", "updated_at", "weight", "journal_entry_ids", "embedding"]
Log = ChangeLog | KeyedLog


def write(done: stages.Ingested, number: int, nodes: Log, edges: Log, stored_edges: DataFrame | None, vocabulary: Vocabulary | None) -> None:
    """Append a batch's changes. The same batch again appends the same ids, and the fold takes them once."""
    nodes.append(stages.changes(number, done.logs, NODE_COLUMNS))
    nodes.append(stages.changes(number, done.nodes, NODE_COLUMNS))
    nodes.append(done.renamed.select(F.lit(changelog.seq(number, changelog.RENAMED)).cast("long").alias("seq"), F.lit("touch").alias("op"), "uuid", "content", "name_key"))
    edges.append(stages.changes(number, done.edges, EDGE_COLUMNS))
    if stored_edges is not None:
        there = stored_edges.select("uuid", "subject_uuid").unionByName(done.edges.select("uuid", "subject_uuid")).distinct()
        edges.append(tombstones(changelog.seq(number, changelog.DEAD), done.tombstones, there))
    if vocabulary is not None:
        vocabulary.append(done.predicates)


def _state(log: ChangeLog, columns: str) -> DataFrame:
    return log.state() if log.exists() else log.spark.createDataFrame([], columns)


def _follow(spark: SparkSession, path: str, schema: str, checkpoint: str, batch, once: bool) -> StreamingQuery:
    stream = spark.readStream.schema(schema).json(path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 minute")).start()


def _in_turn(spark: SparkSession, source: str, nodes: Log, *logs: Log):
    """A batch function with the log's next number, one batch at a time; what it wrote to work with is deleted, and logs that are due are compacted."""
    sequence = Sequence(spark, f"{nodes.path}_sequence")

    def wrap(run):
        def batch(rows: DataFrame, number: int) -> None:
            with sequence.lock, scratch(spark):
                run(rows, sequence.number(source, number))
                for log in (nodes, *logs):
                    if isinstance(log, KeyedLog) and log.due():
                        log.compact()

        return batch

    return wrap


def start(spark: SparkSession, entries_path: str, nodes: Log, edges: Log, checkpoint: str, known: Vocabulary | list[str], make=providers.rules, once: bool = True, **how) -> StreamingQuery:
    """Follow a folder of JSON entries into the two change logs and, where it is one, the stored vocabulary.

    With keyed logs (nodes with ``names``, edges by ``subject_uuid``) a batch reads the buckets of what it
    names; with plain ones it folds all.
    """
    stored = known if isinstance(known, Vocabulary) else None

    @_in_turn(spark, f"entries:{entries_path}", nodes, edges)
    def batch(rows: DataFrame, number: int) -> None:
        rows = materialize(rows, "entries")
        if isinstance(edges, KeyedLog):
            facts, held = edges, nodes
        else:
            facts = materialize(_state(edges, "uuid string, user_id string, subject_uuid string, content string, updated_at timestamp"), "edge-state")
            facts = facts if "updated_at" in facts.columns else facts.withColumn("updated_at", F.col("created_at"))
            held = materialize(_state(nodes, "uuid string, content string, node_type string"), "node-state")
        done = stages.ingest(rows, held, stored.names("predicate") if stored else known, make, edges=facts, **how)
        write(done, number, nodes, edges, done.stored_edges, stored)

    return _follow(spark, entries_path, ENTRIES, checkpoint, batch, once)


def start_consolidation(spark: SparkSession, runs_path: str, nodes: Log, edges: Log, checkpoint: str, known: Vocabulary | list[str], make=providers.rules, once: bool = True) -> StreamingQuery:
    """Consolidate a user's newest logs whenever a scheduler drops a JSON file with ``(user_id, at)`` into a folder."""
    stored = known if isinstance(known, Vocabulary) else None

    @_in_turn(spark, f"runs:{runs_path}", nodes, edges)
    def batch(runs: DataFrame, number: int) -> None:
        who = materialize(runs.groupBy("user_id").agg(F.max("at").alias("run_at")), "runs")
        state = materialize(nodes.state(), "node-state")
        logs = state.join(who.select("user_id"), "user_id", "left_semi").withColumn("updated_at", F.col("created_at"))
        at = who.agg(F.max("run_at")).first()[0]
        facts = edges if isinstance(edges, KeyedLog) else _state(edges, "uuid string, user_id string, subject_uuid string, content string, updated_at timestamp")
        if not isinstance(edges, KeyedLog):
            facts = materialize(facts if "updated_at" in facts.columns else facts.withColumn("updated_at", F.col("created_at")), "edge-state")
        done = stages.consolidate(logs, state, stored.names("predicate") if stored else known, F.lit(at).cast("timestamp"), make, edges=facts)
        write(done, number, nodes, edges, done.stored_edges, stored)

    return _follow(spark, runs_path, RUNS, checkpoint, batch, once)
