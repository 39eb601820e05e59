"""Whole files and requests as rows, and text sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.functions.text import CHUNK_WORDS, source_alias
from memweave.schema import DEFAULT_DOMAIN, DEFAULT_USER


def documents(spark: SparkSession, paths: str | list[str], corpus_id: str, root: str = "", glob: str | None = None) -> DataFrame:
    """``(corpus_id, filename, content)`` of whole text files; names are below ``root``, empty files drop out."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:(//)?", "")
    name = source_alias(F.regexp_replace(path, "^" + root.rstrip("/").replace(".", r"\.") + "/", "") if root else path)
    return reader.text(paths, wholetext=True).select(F.lit(corpus_id).alias("corpus_id"), name.alias("filename"), F.col("value").alias("content")).where("content <> ''")


def dump(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(filename, text)`` of every file below a folder, by name, each with a header."""
    return documents(spark, path, "dump", path, glob).select("filename", F.format_string("==> %s <==\n%s", "filename", "content").alias("text")).orderBy("filename")


def command(spark: SparkSession, words: list[str], domain: str = "general", source: str | None = None, user_id: str = "global") -> DataFrame:
    """Free words as one request row."""
    return spark.createDataFrame([(" ".join(words), domain, source, user_id)], "text string, domain string, source string, user_id string")


#: By kind of request: fields, defaults, and what is wrong when a condition holds.
REQUESTS = {
    "ingest": ("text string, domain string, source string, user_id string, timestamp timestamp", {"domain": DEFAULT_DOMAIN, "user_id": DEFAULT_USER}, {"text IS NULL": "text is missing"}),
    "search": (
        "query string, node_types array<string>, domain string, user_id string, limit int, min_significance double",
        {"node_types": [], "user_id": DEFAULT_USER, "limit": 20, "min_significance": 0.0},
        {"query IS NULL": "query is missing"},
    ),
    "expand": (
        "seed_ids array<string>, query string, hops int, limit_per_edge int, self_seed_neighbor_floor int, debug boolean, user_id string, source_filter string",
        {"hops": 2, "limit_per_edge": 20, "self_seed_neighbor_floor": 40, "debug": False, "user_id": DEFAULT_USER},
        {"seed_ids IS NULL": "seed_ids is missing", "length(query) > 500": "query has over 500 characters"},
    ),
    "corpus": (
        "corpus_id string, documents array<struct<text:string,filename:string>>, user_id string, domain string, chunk_size int",
        {"user_id": DEFAULT_USER, "domain": DEFAULT_DOMAIN, "chunk_size": CHUNK_WORDS},
        {"documents IS NULL OR size(documents) = 0": "no documents", "exists(documents, d -> coalesce(d.text, '') = '' OR d.filename IS NULL)": "a document lacks its text or filename"},
    ),
    "status": ("document_ids array<string>, user_id string, ingest_ts string", {"user_id": DEFAULT_USER, "ingest_ts": ""}, {"document_ids IS NULL": "document_ids is missing"}),
}


def requests(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """JSON requests of a kind, one a line, with defaults, and ``errors``: what is wrong with each, empty for good ones."""
    schema, defaults, wrong = REQUESTS[kind]
    raw = spark.read.schema(f"{schema}, unread string").option("columnNameOfCorruptRecord", "unread").json(paths)
    types = {f.name: f.dataType for f in raw.schema}
    default = lambda c: F.array().cast(types[c]) if defaults[c] == [] else F.lit(defaults[c])
    said = [F.when(F.col("unread").isNotNull(), F.lit("no JSON of this kind")), *(F.when(F.expr(c), F.lit(why)) for c, why in wrong.items())]
    told = raw.withColumn("errors", F.filter(F.array(*said), lambda x: x.isNotNull()))
    return told.select(*[F.coalesce(c, default(c)).alias(c) if c in defaults else F.col(c) for c in raw.columns if c != "unread"], "errors")


def write_dot(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("pos").select("line").write.text(path)  # a subgraph that a person looks at


@dataclass
class Request:
    """Limits on what callers may ask; violations raise ``ValueError``."""

    text: str | None = None
    query: str | None = None
    limit: int = 20
    offset: int = 0
    documents: list = field(default_factory=lambda: [None])

    def __post_init__(self) -> None:
        for bad, why in (
            (self.text is not None and not self.text, "text is empty"),
            (self.query is not None and len(self.query) > 500, "query has over 500 characters"),
            (not 1 <= self.limit <= 500, "limit must be 1 to 500"),
            (self.offset < 0, "offset is negative"),
            (not self.documents, "no documents"),
        ):
            if bad:
                raise ValueError(why)
