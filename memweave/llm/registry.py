"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memweave.llm import bpe, exact_dedup, gif_media, hard_negatives, html_text, language_id, line_dedup, minhash, packing, pipeline, prefix_trie, suffix_dedup, toxicity, warc
from memweave.runtime import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_features(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_html_text": op2_html_text,
        "op3_minhash": op3_minhash,
        "op4_packing": op4_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_bpe": op8_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_gif_media": op10_gif_media,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_warc": op12_warc,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op1_exact_dedup": exact_dedup.ORACLE, "op3_minhash": minhash.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op12_warc": warc.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
    if pipeline.ORACLE_SQL:
        out["pipeline"] = pipeline.ORACLE_SQL
    return out
