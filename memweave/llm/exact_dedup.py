"""Exact dedup against a persistent digest index. DataFrame operations only.

The index is a Parquet table with one row for each distinct text, bucketed and
sorted by SHA-256 digest. A batch is reduced to its distinct digests (partial
aggregation, so a text with a third of all rows costs one row a task), those are
anti-joined against the index by sort-merge on the index's own buckets, and the
rest is appended.

Defined results: a null text is the empty text; equal texts are equal byte for
byte. Within a batch the row with the largest doc_id stays; rows that repeat both
doc_id and text are one document, so they share one verdict. A null doc_id loses
to any other. A text that the index held before the batch loses to the index, with the
``keep_id`` and ``group_size`` of the batch that brought it. An empty batch gives an empty
result. Columns other than the two named pass by.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.runtime import new_path, track

#: Digests of a bucket, about: 0.2 GB. The number of buckets follows the index, as a power of two.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS = 16
MANIFEST = "generation int, buckets int, folder string"


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


def digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class DigestIndex:
    """A persistent table ``(digest, keep_id, group_size)``, bucketed and sorted by digest, in a folder.

    The folder, at ``path`` or under its ``name`` in the warehouse, is all there is to it: ``manifest``
    has a row ``(generation, buckets, folder)`` for each time the index was laid out, written after the
    files. Readers of a layout before keep its files. Any session that opens the folder meets the index as the last one left it; an index
    has one writer at a time. One without name and path serves one call, and ``runtime.clear``
    deletes it.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        if not path:
            path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}" if name else new_path(spark, "digest-index")
            if not name:
                track(spark, path)
        self.path = path.rstrip("/")
        last = self._manifest().orderBy(F.desc("generation")).first()
        self.generation, self.buckets, self.folder = tuple(last) if last else (0, buckets or LEAST_BUCKETS, self._folder())
        if not last:
            self._state()
        self.table = self._opened(self.folder, self.buckets)

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def _state(self) -> None:
        row = {"generation": F.lit(self.generation), "buckets": F.lit(self.buckets), "folder": F.lit(self.folder)}
        self.spark.range(1).select(*[c.alias(k) for k, c in row.items()]).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _folder(self) -> str:
        return f"files-{uuid.uuid4().hex}"

    def _opened(self, folder: str, buckets: int) -> str:
        """A name in this session's catalog for a layout, by which Spark knows its buckets."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet OPTIONS (path '{self.path}/{folder}') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        return name

    def _write(self, rows: DataFrame, name: str, folder: str, buckets: int) -> None:
        # one writing task for each bucket: one file a bucket and batch
        ready = rows.repartition(buckets, "digest").select("digest", "keep_id", "group_size")
        ready.write.format("parquet").mode("append").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/{folder}").saveAsTable(name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def grow(self, more: int) -> None:
        """Lay out with more buckets where the index and ``more`` rows want twice as many."""
        held = self.rows().count()  # from the files' footers
        wanted = buckets_for(held + more)
        if wanted < 2 * self.buckets:
            return
        folder = self._folder()
        name = self._opened(folder, wanted)
        if held:
            self._write(self.rows(), name, folder, wanted)
        self.forget()
        self.generation, self.buckets, self.folder, self.table = self.generation + 1, wanted, folder, name
        self._state()

    def forget(self) -> None:
        """Out of the session's catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE {self.table}")

    def add(self, batch: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Append the batch's digests that the index lacks."""
        self.grow(batch.count())
        groups = (
            batch.select(digest(text).alias("digest"), F.col(doc_id).cast("long").alias("doc_id"))
            .groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        )
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh, self.table, self.folder, self.buckets)

    def verdicts(self, batch: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row for each row of the batch, which ``add`` must have seen.

        The index's files are read without their bucketing here: both sides of the
        join are then plain shuffles, and Spark can split the side with a hot text.
        """
        index = self.spark.read.schema("digest binary, keep_id bigint, group_size bigint").parquet(f"{self.path}/{self.folder}")
        seen = batch.select(F.col(doc_id).cast("long").alias("doc_id"), digest(text).alias("digest"))
        return seen.join(index.hint("merge"), "digest", "left").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(batch: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add a batch to an index and return the verdict on every row. Without an index, one is made for this call."""
    own = index or DigestIndex(batch.sparkSession)
    own.add(batch, doc_id, text)
    out = own.verdicts(batch, doc_id, text)
    if index is None:
        own.forget()
    return out


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
