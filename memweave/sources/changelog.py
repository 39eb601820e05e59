"""State without updates in place: an append-only change log, folded to the latest state.

Every change is a row ``(seq, uuid, op, fields...)``. Reading folds the log by key with
aggregates that combine before the shuffle; compaction writes the folded state to a new
path, so a path that is being read never changes.
"""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["node_type", "domain", "user_id", "source", "subject_uuid", "predicate", "object_uuid", "created_at"]
LAST = ["content", "weight", "metadata", "name_key", "embedding", "document_id", "pipeline_done_at", "pipeline_error"]


def fold(log: DataFrame) -> DataFrame:
    """The latest state by ``uuid``.

    Identity fields keep their first value, others take the last that is not null,
    ``updated_at`` is the latest and never goes back, and ``journal_entry_ids`` is the ordered
    distinct union. Touches of an unknown key make no
    row: a key lives from its first ``create``.
    """
    def kept(c: str, by) -> Column:
        return by(c, "seq").alias(c)

    first = [kept(c, lambda x, s: F.min_by(F.when(F.col(x).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(s)))) for c in FIRST if c in log.columns]
    last = [kept(c, lambda x, s: F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(s)))) for c in LAST if c in log.columns]
    last += [F.max("updated_at").alias("updated_at")] if "updated_at" in log.columns else []
    journal = []
    if "journal_entry_ids" in log.columns:
        said = F.array_sort(F.collect_list(F.when(F.col("journal_entry_ids").isNotNull(), F.struct("seq", "journal_entry_ids"))))
        journal = [F.array_distinct(F.flatten(F.transform(said, lambda x: x["journal_entry_ids"]))).alias("journal_entry_ids")]
    return log.groupBy("uuid").agg(*first, *last, *journal, F.bool_or(F.col("op") == "create").alias("lives")).where("lives").drop("lives")


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, changes: DataFrame) -> None:
        changes.write.mode("append").parquet(self.path)

    def exists(self) -> bool:
        try:
            return bool(self.spark.read.parquet(self.path).columns)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False

    def log(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def state(self) -> DataFrame:
        return fold(self.log())

    def compact(self, new_path: str) -> ChangeLog:
        """The folded state as the first entries of a new log."""
        last = self.log().agg(F.max("seq")).first()[0]
        self.state().withColumn("seq", F.lit(last).cast("long")).withColumn("op", F.lit("create")).write.parquet(new_path)
        return ChangeLog(self.spark, new_path)

    def wipe(self, new_path: str) -> ChangeLog:
        """An empty log of the same columns, at a new path; only ever on an explicit call. What reads the old one is not disturbed."""
        self.log().limit(0).write.parquet(new_path)
        return ChangeLog(self.spark, new_path)


#: Changes of one number are ordered by kind: creations, touches, renames, tombstones.
CREATED, TOUCHED, RENAMED, DEAD = range(4)
_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)


class Sequence:
    """Numbers for the batches of all sources that write to one log, in the order in which they come.

    A table ``(source, batch, number)``, written before the batch's changes: a batch that runs again
    gets its number again. Sources of one driver take turns under ``lock``; a log has one driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path, _LOCKS[path]

    def number(self, source: str, batch: int) -> int:
        with self.lock:
            try:
                held = self.spark.read.schema("source string, batch long, number long").parquet(self.path)
                own, last = held.agg(F.max(F.when((F.col("source") == source) & (F.col("batch") == batch), F.col("number"))), F.max("number")).first()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                own, last = None, None
            if own is None:
                own = 0 if last is None else last + 1
                self.spark.createDataFrame([(source, batch, own)], "source string, batch long, number long").coalesce(1).write.mode("append").parquet(self.path)
            return own


def seq(number: int, kind: int) -> int:
    return 4 * number + kind


def marks(seq: int, document_ids: DataFrame, failed: DataFrame, at: str) -> DataFrame:
    """Every document of ``(uuid)`` is done at ``at``; those of ``failed (uuid, error)`` have an error as well."""
    out = document_ids.select("uuid").distinct().join(failed.groupBy("uuid").agg(F.min("error").alias("pipeline_error")), "uuid", "left")
    return out.select(F.lit(seq).cast("long").alias("seq"), "uuid", F.lit("touch").alias("op"), F.lit(at).alias("pipeline_done_at"), "pipeline_error")


def touches(seq: Column | int, rows: DataFrame, journal_id: Column, now: Column) -> DataFrame:
    """Observe keys again: the journal grows and ``updated_at`` moves; a dead edge stays dead."""
    return rows.select((F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("seq"), "uuid", F.lit("touch").alias("op"), F.array(journal_id).alias("journal_entry_ids"), now.alias("updated_at"))


def tombstones(seq: int, keys: DataFrame, state: DataFrame) -> DataFrame:
    """Weight 0 for the keys that exist; others are no-ops."""
    subject = ["subject_uuid"] if "subject_uuid" in state.columns else []
    return state.join(keys.select("uuid").distinct(), "uuid", "left_semi").select(F.lit(seq).cast("long").alias("seq"), "uuid", *subject, F.lit("tombstone").alias("op"), F.lit(0.0).alias("weight"))
