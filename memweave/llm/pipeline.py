"""A training corpus from ``documents``: five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again for the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.llm import language_id, line_dedup, minhash, packing, suffix_dedup
from memweave.runtime import materialize, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the predicted one.

    Rejected is what no language can be told of: texts without a letter.
    """
    ship(spark)
    model = language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    marked = language_id.annotate(docs.select(*COLUMNS), model)
    return marked.where(F.col("lang_pred") != "und").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are cut from the later one."""
    ship(spark)
    return _counted(line_dedup.remove_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id, of equals the one with the smallest text digest."""
    ship(spark)
    return minhash.remove_near_duplicates(docs).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut."""
    ship(spark)
    return _counted(suffix_dedup.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoder's ids as padded sequences, in optimal length buckets and token-budget batches."""
    ship(spark)
    return packing.pack(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Language models, alignments and iterated components are beyond SQL.
ORACLE_SQL = None
