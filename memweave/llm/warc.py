"""Content-addressed WARC archive.

An archive is two Parquet tables in a folder. ``payloads`` has each distinct payload once,
under its SHA-256 (in ``shard`` folders by its first bits, so that a lookup of some reads some).
``headers`` has one row for each record: the exact bytes of the WARC header and of the HTTP
header, and the digest of the payload that follows, if one does. A record's bytes are the
header block, the payload joined by its digest, and the two line ends that close a record;
``restore`` builds them for all records, ``read`` parses such bytes again.

A stored payload is verified: when it is read, its SHA-256 is computed from its bytes and
must be its name, its SHA-1 must be what the record's header says, and a record's length what
Content-Length says; else the job fails with the record's id. When it is written, rows of one
name must agree in length and SHA-1.

Of records with equal payloads of at least ``LEAST`` bytes, that with the largest id is the
response and the others are revisits (WARC 1.1, identical-payload-digest) that refer to it
and have no payload; records of smaller payloads are all responses, with one stored payload.

Only digests are grouped (partial counts) and payload bytes move twice: to find one row of
each name, deflated, and to meet their headers. Both joins are plain shuffles, which Spark can
split at a payload that many records share.

Defined results: a null payload is empty; a null id loses to any other, and records without
one are told apart by payload only. Rows that repeat an id and a payload are records of their
own: with the largest id, all are responses, and revisits refer to the id. A null target has no
WARC-Target-URI; spaces and control characters of a target are percent-encoded. An empty
table is an empty archive. Columns other than the three named pass by.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.llm.batches import slices
from memweave.runtime import materialize, new_path

LEAST = 1000
SHARDS = 16
END = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(record: Column, digest: Column) -> Column:
    """A record's URN, the same whenever it is written."""
    x = F.md5(F.concat_ws("/", F.coalesce(record.cast("string"), F.lit("null")), F.hex(digest)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _target(url: Column) -> Column:
    odd = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x00-\x20\x7f]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(odd, "")).otherwise(url)


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null has none."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in fields))


def _recoded(bodies: DataFrame, code: Callable[[bytes], bytes]) -> DataFrame:
    """``bodies (digest, body)`` with each body as ``code`` makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            yield pa.record_batch([b.column(0), pa.array([code(x.as_py()) for x in b.column(1)], pa.binary())], names=["digest", "body"])

    return bodies.mapInArrow(run, "digest binary, body binary")


def distinct_payloads(bodies: DataFrame) -> DataFrame:
    """One row of ``bodies (digest, body)`` for each digest; what is shuffled is deflated."""
    return _recoded(_recoded(bodies, lambda x: zlib.compress(x, 1)).dropDuplicates(["digest"]), zlib.decompress)


def write(pages: DataFrame, path: str, record: str = "page_id", target: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", kind: str = "text/html; charset=utf-8", least: int = LEAST) -> None:
    """Write an archive of ``pages`` to ``path``, which must not exist."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(record).alias("record"), F.col(target).alias("target"), body.alias("body"))
    rows = rows.select("record", "target", F.unhex(F.sha2("body", 256)).alias("digest"), F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("length"))
    wrong = F.raise_error(F.concat(F.lit("two payloads of one digest: "), F.hex("digest"))).cast("binary")
    groups = rows.groupBy("digest").agg(F.max("record").alias("response"), F.min("sha1").alias("one"), F.max("sha1").alias("two"), F.min("length").alias("short"), F.max("length").alias("long"))
    groups = groups.select(F.when((F.col("one") == F.col("two")) & (F.col("short") == F.col("long")), F.col("digest")).otherwise(wrong).alias("digest"), "response")
    told = rows.join(groups.hint("merge"), "digest").withColumn("revisit", (F.col("length") >= least) & ~F.col("record").eqNullSafe(F.col("response")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: {kind}{END}Content-Length: "), F.col("length").cast("string"), F.lit(END * 2))
    follows = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("length"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _lines(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", _uuid(F.col("record"), F.col("digest"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _target(F.col("target"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("WARC-Profile", F.when(F.col("revisit"), REVISIT)), ("WARC-Refers-To", F.when(F.col("revisit"), _uuid(F.col("response"), F.col("digest")))),
            ("Source-Record", F.col("record")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", follows),
        ),
        F.lit(END),
    )
    headers = told.withColumn("http", http).select(header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http"), F.when(~F.col("revisit"), F.col("digest")).alias("digest"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    bodies = distinct_payloads(pages.select(body.alias("body")).select(F.unhex(F.sha2("body", 256)).alias("digest"), "body"))
    bodies.withColumn("shard", F.conv(F.substring(F.hex("digest"), 1, 1), 16, 10).cast("int")).write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/payloads")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the bytes of every record, headers joined with payloads; each payload proves its name."""
    headers = spark.read.schema("header binary, http binary, digest binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, body binary, shard int").parquet(f"{path}/payloads").drop("shard")
    wrong = F.raise_error(F.concat(F.lit("a payload is not what its digest says: "), F.hex("digest")))
    payloads = payloads.select("digest", F.when(F.unhex(F.sha2("body", 256)) == F.col("digest"), F.col("body")).otherwise(wrong.cast("binary")).alias("body"))
    lost = F.raise_error(F.concat(F.lit("no payload for "), F.hex("digest")))
    body = F.when(F.col("digest").isNull(), F.lit(b"")).when(F.col("body").isNull(), lost.cast("binary")).otherwise(F.col("body"))
    met = headers.join(payloads.hint("merge"), "digest", "left")
    return met.select(F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"))


def read(records: DataFrame) -> DataFrame:
    """Parse record bytes: ``type, record_id, refers_to_id, target, source, digest, http, payload``, with lengths and digests held against the bytes."""
    blank = END * 2
    head = F.substring_index(F.col("record").cast("string"), blank, 1)
    split = records.select("record", head.alias("head")).withColumn("block", F.expr("substring(record, octet_length(head) + 5, octet_length(record) - octet_length(head) - 8)"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    told = split.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to_id"), field("WARC-Target-URI").alias("target"), field("Source-Record").alias("source"),
        F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]*)", 1).alias("digest"), field("Content-Length").cast("long").alias("said"), "block", F.substring_index(F.col("block").cast("string"), blank, 1).alias("http"),
    )
    told = told.withColumn("payload", F.expr("substring(block, octet_length(http) + 5)"))
    wrong = F.raise_error(F.concat(F.lit("a record is not what its header says: "), F.col("record_id")))
    sound = (F.col("said") == F.octet_length("block")) & ((F.col("type") == "revisit") | (F.sha1("payload") == F.col("digest")))
    # in the columns, not as a filter: a filter is rewritten with others on the same columns
    digest, payload = (F.when(sound, F.col(c)).otherwise(wrong.cast(kind)).alias(c) for c, kind in (("digest", "string"), ("payload", "binary")))
    return told.select("type", "record_id", "refers_to_id", "target", "source", digest, "http", payload)


def warc(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages``, read the archive back and tell each record: what it is, and its full payload's length and digest."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path)
    records = read(restore(spark, path)).select("type", "record_id", "refers_to_id", "source", "digest", F.octet_length("payload").cast("long").alias("length"))
    records = materialize(records, "warc-records")  # a few passes follow
    own = F.col("source").cast("long").alias("page_id")
    responses = records.where("type = 'response'").select(own, F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    # a revisit's payload is its response's; rows that repeat a response are one here
    named = records.where("type = 'response'").groupBy("record_id").agg(F.first("length").alias("payload_bytes"), F.first("digest").alias("told"), F.first("source").cast("long").alias("refers_to"))
    revisits = records.where("type = 'revisit'").join(named.withColumnRenamed("record_id", "refers_to_id").hint("merge"), "refers_to_id", "left")
    wrong = F.raise_error(F.concat(F.lit("a revisit's response is not there: "), F.col("record_id"))).cast("string")
    digest = F.when(F.col("told") == F.col("digest"), F.col("told")).otherwise(wrong)
    return responses.unionByName(revisits.select(own, "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"))


ORACLE = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""
