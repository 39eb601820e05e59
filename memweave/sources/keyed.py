"""State that lasts: a folded snapshot in buckets of a key and the changes since, read by key.

A ``KeyedLog`` is a folder with generations. ``snapshot-<g>`` has the folded state,
``tail-<g>`` the changes that came after it, both in folders by bucket of the key column, so
that a batch reads the buckets that its keys fall into and folds those. ``names-<g>`` leads from a
name key to ids, in buckets of its own. ``current`` has a row for each generation, written last:
a reader that started before a compaction reads the old one to its end, and a compaction
that dies leaves nothing that is read.

Journals are a table beside the state, never an array of it: ``journal`` has a row for each id that a
change adds, with its place, in buckets of the same key; ``last_entries`` cuts the last of each key by a
group limit. ``counts`` are kept up to date: those of the snapshot are stored with it, and the keys
that the tail has created are added on reading.

``compact`` folds everything into the next generation. ``due`` says when: once the tail has
``RATIO`` times the snapshot's rows, so that a row is rewritten a constant number of times on
average. Nodes are kept by ``uuid``; edges by ``subject_uuid``, as a fact is met together with the
other facts of its subject.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memweave.runtime import materialize
from memweave.sources.changelog import fold

FIELDS = (
    "seq long, uuid string, op string, node_type string, domain string, user_id string, source string, subject_uuid string, predicate string, object_uuid string, created_at timestamp, content string, weight double, "
    "metadata string, name_key string, embedding array<double>, updated_at timestamp, document_id string, pipeline_done_at string, pipeline_error string"
)
JOURNAL = "key string, uuid string, seq long, pos int, log_id string"
#: What rows are counted by.
COUNTED = ("node_type", "predicate")
RATIO, LEAST_TAIL = 0.5, 10_000
#: Buckets that a scan is told by value; a batch that names more reads all and joins.
MOST_BUCKETS = 1024


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, key: str = "uuid", buckets: int = 64, names: bool = False):
        self.spark, self.path, self.key, self.buckets, self.names = spark, path, key, buckets, names

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, schema: str, path: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        return self._read("generation int", f"{self.path}/current").agg(F.max("generation")).first()[0] or 0

    def exists(self) -> bool:
        return True

    def _write(self, df: DataFrame, path: str, key: str) -> None:
        placed = df.withColumn("bucket", self._bucket(F.col(key)))
        # small buckets share a writing task, large ones are split
        placed.hint("rebalance", F.col("bucket")).write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(path)

    def append(self, changes: DataFrame) -> None:
        """Add changes; a column that they lack is not changed by them. Edges name their subject in every change."""
        has = set(changes.columns)
        told = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in has else F.lit(None).cast(f.dataType).alias(f.name) for f in self._fields()])
        g = self.generation()
        self._write(told, f"{self.path}/tail-{g}", self.key)
        if "journal_entry_ids" in has:
            rows = changes.select(F.col(self.key).alias("key"), "uuid", F.col("seq").cast("long").alias("seq"), F.posexplode("journal_entry_ids").alias("pos", "log_id"))
            self._write(rows, f"{self.path}/journal", "key")
        if self.names and "name_key" in has:
            self._write(told.where("name_key IS NOT NULL").select("name_key", "uuid").distinct(), f"{self.path}/names-{g}", "name_key")

    def _fields(self):
        return self.spark.createDataFrame([], FIELDS).schema.fields

    def log(self) -> DataFrame:
        """All rows of the current generation, unfolded."""
        g, schema = self.generation(), f"{FIELDS}, bucket int"
        return self._read(schema, f"{self.path}/snapshot-{g}").unionByName(self._read(schema, f"{self.path}/tail-{g}"))

    def _picked(self, df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        if not df.inputFiles():  # nothing is stored yet
            return df
        wanted = keys.select(F.col("key").alias("__key")).where("__key IS NOT NULL")
        buckets = [r[0] for r in wanted.select(self._bucket(F.col("__key"))).distinct().limit(MOST_BUCKETS + 1).collect()]
        if len(buckets) <= MOST_BUCKETS:
            df = df.where(F.col("bucket").isin(buckets))
        return df.join(wanted, F.col(column) == F.col("__key"), "left_semi")

    def state(self) -> DataFrame:
        """The latest state of all keys, without journals."""
        return fold(self.log().drop("bucket"))

    def journal(self, keys: DataFrame | None = None) -> DataFrame:
        """``(uuid, log_id, seq, pos)``: each id of a journal at its first place; of ``keys (key)``, the key column's values, or of all."""
        rows = self._read(f"{JOURNAL}, bucket int", f"{self.path}/journal")
        rows = rows if keys is None else self._picked(rows, "key", keys)
        return rows.groupBy("uuid", "log_id").agg(F.min(F.struct("seq", "pos")).alias("at")).select("uuid", "log_id", "at.seq", "at.pos")

    def last_entries(self, keys: DataFrame | None = None, n: int = 2) -> DataFrame:
        """``(uuid, log_id, place)``: the last ``n`` of each journal, the oldest of them first."""
        rank = F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("seq"), F.desc("pos"), "log_id"))
        last = self.journal(keys).withColumn("rank", rank).where(F.col("rank") <= n)
        return last.select("uuid", "log_id", F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("rank"))).alias("place"))

    def counts(self, column: str) -> DataFrame:
        """``(value, n)``: living keys by the value of one of ``COUNTED``, from the stored counts and the tail alone."""
        g, schema = self.generation(), f"{FIELDS}, bucket int"
        tail = fold(self._read(schema, f"{self.path}/tail-{g}").drop("bucket")).select(F.col(self.key).alias("key"), "uuid", F.col(column).alias("value"))
        # what the snapshot has already: read by the tail's keys, and nothing but ids
        held = self._picked(self._read(schema, f"{self.path}/snapshot-{g}").select("uuid", F.col(self.key).alias("at"), "bucket"), "at", tail.select("key"))
        new = tail.join(held.select("uuid"), "uuid", "left_anti").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        stored = self._read("name string, value string, n long", f"{self.path}/counts-{g}").where(F.col("name") == column).select("value", "n")
        return stored.unionByName(new).groupBy("value").agg(F.sum("n").alias("n"))

    def pick(self, keys: DataFrame, whole: bool = False) -> DataFrame:
        """The state of the rows with one of ``keys (key)``: the key column's values or, with ``names``, name keys.

        ``whole`` is for matches by vector, which look at all.
        """
        if whole:
            return self.state()
        if not self.log().inputFiles():
            return fold(self.log().drop("bucket"))
        keys = materialize(keys.select("key").distinct(), "picked-keys")  # they are looked at several times
        if self.names:
            named = self._picked(self._read("name_key string, uuid string, bucket int", f"{self.path}/names-{self.generation()}"), "name_key", keys)
            keys = keys.select("key").unionByName(named.select(F.col("uuid").alias("key"))).distinct()
        return fold(self._picked(self.log(), self.key, keys).drop("bucket"))

    def due(self) -> bool:
        g, schema = self.generation(), f"{FIELDS}, bucket int"
        tail, held = (self._read(schema, f"{self.path}/{x}-{g}").count() for x in ("tail", "snapshot"))  # from the files' footers
        return tail > max(LEAST_TAIL, RATIO * held)

    def compact(self) -> None:
        """Fold snapshot and tail into the next generation; the one before the current stays for its readers."""
        g = self.generation()
        last = self.log().agg(F.max("seq")).first()[0]
        folded = self.state().withColumn("seq", F.lit(last).cast("long")).withColumn("op", F.lit("create"))
        self._write(folded, f"{self.path}/snapshot-{g + 1}", self.key)
        if self.names:
            self._write(folded.where("name_key IS NOT NULL").select("name_key", "uuid"), f"{self.path}/names-{g + 1}", "name_key")
        written = self._read(f"{FIELDS}, bucket int", f"{self.path}/snapshot-{g + 1}")
        for column in COUNTED:
            written.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(column).alias("name"), "value", "n").coalesce(1).write.mode("append").parquet(f"{self.path}/counts-{g + 1}")
        self.spark.createDataFrame([(g + 1,)], "generation int").write.mode("append").parquet(f"{self.path}/current")
