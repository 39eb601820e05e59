"""Packing into length buckets that are optimal for the corpus, and token-budget batches.

1. Texts are counted in tokens and cut into sequences of at most ``MAX_LEN`` tokens, each
   with its place in the text. Tokens are runs without white space, the ids that the byte
   pair encoder gives with a named vocabulary, those of a named column, or what a named
   length column counts.
2. The global histogram of sequence lengths, of at most ``MAX_LEN`` cells, goes to the
   driver, and dynamic programming chooses the ``BUCKETS`` upper bounds with the least
   padding.
3. In each bucket, sequences are numbered over the whole corpus and cut into batches of
   ``BUDGET // bound`` rows. The numbers come from sub-counts of shards of about
   ``SHARD`` rows, so that no bucket is one task.

Defined results: a null text or one without tokens makes one row of length 0 without
bucket and batch. All other tokens are in exactly one sequence. Sequences are numbered
by shard, doc_id, piece, length and a digest of what they hold, so that two runs agree;
repeated rows are sequences of their own. ``start`` and
``end`` are the places of a sequence's first character and of the one after its last (of
ids, where ids or lengths are named), so that ``text[start:end]`` is what is trained on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memweave.llm import bpe
from memweave.llm.remembered import rest
from memweave.runtime import materialize

MAX_LEN, BUCKETS, BUDGET = 2048, 16, 65_536
SHARD = 50_000
TOKEN = re.compile(r"\S+")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, the largest length among them, with the least total padding.

    ``lengths`` are distinct and ascending. Exact: best[b][j] is the least padding of the
    first j lengths in b buckets, over all places of the last bound.
    """
    m = len(lengths)
    if not m:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, m)):
        now, choice = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            k = int(cost.argmin())
            if cost[k] < now[j]:
                now[j], choice[j] = cost[k], k
        choices.append(choice)
        best = now
    bounds, j = [], m
    for choice in reversed(choices):
        if j and choice[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(choice[j])
    return bounds[::-1]


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


NAMES = ["doc_id", "piece", "n_tokens", "start", "end", "tie"]


def sequences(docs: DataFrame, max_len: int = MAX_LEN, doc_id: str = "doc_id", text: str = "text", length: str | None = None, tie: str | None = None) -> DataFrame:
    """``(doc_id, piece, n_tokens, start, end, tie)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, ties = [], [], []
            for k, t in enumerate(b.column(1)):
                t = t.as_py() or ""
                cut = cuts(t, max_len)
                keys += [k] * len(cut)
                rows += cut
                ties += [_digest(t[s:e].encode()) for _, _, s, e in cut]
            yield pa.record_batch([b.column(0).take(pa.array(keys, pa.int64())), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(4)), pa.array(ties, pa.int64())], names=NAMES)

    key = F.col(doc_id).cast("long").alias("doc_id")
    if not length:
        return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))
    counted = docs.select(key, F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("n"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("tie"))
    last = F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)) - 1
    pieces = counted.select("doc_id", "n", "tie", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start, end = F.col("piece") * max_len, F.least(F.col("n"), (F.col("piece") + 1) * max_len)
    return pieces.select("doc_id", "piece", (end - start).alias("n_tokens"), start.alias("start"), end.alias("end"), "tie")


def encoded(docs: DataFrame, vocabulary: str, max_len: int = MAX_LEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``sequences`` of the encoder's ids, with ``input_ids``; places count ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(vocabulary)
        for keys, texts in bpe.groups(batches, 1 << 20):
            rows = []
            for k, raw in zip(keys, encoder.encode_batch(texts), strict=True):
                ids = np.frombuffer(raw, "<u4").astype(np.int32)
                for piece, start in enumerate(range(0, max(len(ids), 1), max_len)):
                    part = ids[start : start + max_len]
                    rows.append((k, piece, len(part), start, start + len(part), _digest(part.tobytes()), part))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([*(pa.array(next(columns), pa.int64()) for _ in NAMES), pa.array(next(columns), pa.list_(pa.int32()))], names=[*NAMES, "input_ids"])
        rest()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES) + ", input_ids array<int>")


def cuts(text: str, max_len: int) -> list[tuple[int, int, int, int]]:
    """``(piece, n_tokens, start, end)`` of a text's sequences."""
    n = len(text.split())
    if n <= max_len:
        return [(0, n, 0, len(text))]
    at = [m.span() for m in TOKEN.finditer(text)]
    return [(k // max_len, min(max_len, n - k), at[k][0], at[min(k + max_len, n) - 1][1]) for k in range(0, n, max_len)]


def padded_ids(packed: DataFrame, tokens: DataFrame, pad_id: int = 0, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``packed`` (by the length of ``ids``) with ``input_ids``: each sequence's ids, filled up to its bucket's length.

    ``tokens (doc_id, ids)`` has one row for each doc_id.
    """
    own = tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("__ids"))
    joined = packed.join(own, packed["doc_id"].eqNullSafe(own["doc_id"])).drop(own["doc_id"])
    part = F.slice("__ids", F.col("start").cast("int") + 1, F.col("n_tokens").cast("int"))
    filled = F.concat(part, F.array_repeat(F.lit(pad_id), F.coalesce("padding", F.lit(0)).cast("int")))
    return joined.withColumn("input_ids", filled).drop("__ids")


def pack(
    docs: DataFrame,
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    doc_id: str = "doc_id",
    text: str = "text",
    length: str | None = None,
    ids: str | None = None,
    vocabulary: str | None = None,
    pad_id: int = 0,
) -> DataFrame:
    """``(doc_id, piece, n_tokens, start, end, bucket_len, batch, row, padding)``, one row for each sequence.

    ``length`` names a column with counts, ``ids`` one with lists of token ids. With a
    ``vocabulary`` texts are encoded, and ``input_ids`` has each sequence's ids, filled up with
    ``pad_id`` to its bucket's length.
    """
    tie = None
    if ids:
        docs, length, tie = docs.select(F.col(doc_id), F.coalesce(F.size(ids), F.lit(0)).alias("__n"), F.xxhash64(ids).alias("__tie")), "__n", "__tie"
    made = encoded(docs, vocabulary, max_len, doc_id, text) if vocabulary else sequences(docs, max_len, doc_id, text, length, tie)
    cut = materialize(made, "sequences")
    own = ["input_ids"] if vocabulary else []
    histogram = cut.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).orderBy("n_tokens").collect()  # at most max_len rows
    bounds = optimal_bounds(np.array([r["n_tokens"] for r in histogram]), np.array([r["c"] for r in histogram]), buckets)
    total = sum(r["c"] for r in histogram)
    shards = max(1, -(-total // SHARD))
    bound = F.lit(None).cast("long")
    for b in reversed(bounds):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bound)
    placed = cut.withColumn("bucket_len", F.when(F.col("n_tokens") > 0, bound)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)))
    some = placed.where("bucket_len IS NOT NULL")
    counts = some.groupBy("bucket_len", "shard").agg(F.count(F.lit(1)).alias("c"))  # buckets x shards rows
    before = counts.select(
        "bucket_len", "shard", (F.sum("c").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("before")
    )
    at = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "piece", "n_tokens", "tie")) - 1
    numbered = some.withColumn("at", at).join(before, ["bucket_len", "shard"]).withColumn("at", F.col("at") + F.coalesce("before", F.lit(0)))
    per = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    full = numbered.select("doc_id", "piece", "n_tokens", "start", "end", "bucket_len", *own, F.floor(F.col("at") / per).cast("long").alias("batch"), (F.col("at") % per).cast("long").alias("row"))
    empty = placed.where("bucket_len IS NULL").select("doc_id", "piece", "n_tokens", "start", "end", "bucket_len", *own, F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("row"))
    out = full.unionByName(empty).withColumn("padding", F.col("bucket_len") - F.col("n_tokens"))
    if not vocabulary:
        return out
    fill = F.array_repeat(F.lit(pad_id), F.coalesce("padding", F.lit(0)).cast("int"))
    return out.select(*[c for c in out.columns if c != "input_ids"], F.concat("input_ids", fill).alias("input_ids"))
