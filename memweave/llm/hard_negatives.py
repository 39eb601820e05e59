"""Hard negatives by distributed radix selection over integer scores.

A window is (anchor, positive) with the scores between which its negatives lie. For all
windows at once, the key of the kth row is found digit by digit: rows are counted by the
leading digit of their distance from the window's top score, the digit that holds the kth
row is kept, and only that bucket is split by the next digit. Where more rows than wanted
share the kth score, the digits go on over the vec_id, so that ties of any number are
decided the same way. When every window knows its last row, one more pass gathers the rows
up to it, k for each window. The positives of an anchor are selected alike, from one
window over all scores.

Scores are matrix products of blocks: all rows in blocks of ``ROWS`` meet the windows in
blocks of about ``ANCHORS`` anchors, each two in one row of a join whose key is (block of
windows, share of the row blocks). A pair of blocks sends for each window the counts down
to the digit that holds its own kth row, since the kth of all is not further: at most k
counts. Windows are a written table that each pass rewrites; nothing of them reaches the
driver but the number of open ones.

Defined results: a row takes part if label, vector and all components are not null and
finite, vec_id is not null, and no component reaches ``LARGEST`` after scaling (so that
scores of up to 2047 components fit 64 bits). Shorter vectors are filled with zeros. Rows that repeat a vec_id are
rows of their own; as anchors they are one, that with the smallest (label, vector). Rows of
the anchor's vec_id are neither its positives nor its negatives. Anchors without positives,
and windows without negatives, give no rows. Columns other than the three named pass by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memweave.runtime import materialize, release

ROWS, ANCHORS = 4096, 512
#: Row blocks of a share, about.
SHARE = 4
LARGEST = 1 << 26
DIGIT = 8
WINDOW = ["anchor_id", "positive_id", "same", "k", "low", "high", "low_id", "high_id", "taken"]


def usable(embeddings: DataFrame, scale: int, shift: Column | None) -> DataFrame:
    """``vec_id, label, v``: rows that take part, with integer components."""
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    given = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    given = given.where(F.forall("v", lambda x: F.coalesce((F.abs(x * scale) < LARGEST) & ~F.isnan(x), F.lit(False))))
    return given.select("vec_id", (F.col("label") if shift is None else shift).alias("label"), F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``ROWS`` rows: ids, labels and one matrix."""
    for b in batches:
        for k in range(0, len(b), ROWS):
            part = b.slice(k, ROWS)
            ids, labels, v = part["vec_id"].to_numpy(), part["label"].to_numpy(), part["v"].to_pylist()
            x = np.zeros((len(v), max(1, max(map(len, v)))), "<i4")
            for row, own in zip(x, v, strict=True):
                row[: len(own)] = own
            yield pa.RecordBatch.from_pylist([{"ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i4").tobytes(), "matrix": x.tobytes(), "width": x.shape[1], "mark": zlib.crc32(ids.tobytes())}])


def blocks_of(rows: DataFrame) -> DataFrame:
    return materialize(rows.mapInArrow(_packed, "ids binary, labels binary, matrix binary, width long, mark long"), "negatives-blocks")


def _product(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``a`` and ``x``, as far as both have components."""
    n = min(a.shape[1], x.shape[1])
    a, x = a[:, :n], x[:, :n]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * n
    if most < 1 << 53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


def _scored(batches: Iterator[pa.RecordBatch]):
    """For each window of each pair of blocks: its values, and ids and scores of the rows of its kind between its bounds."""
    for b in batches:
        for n in range(len(b)):
            one = b.slice(n, 1)
            get = lambda k: one[k][0].as_py()  # noqa: B023, E731
            ids, labels = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("labels"), "<i4")
            x = np.frombuffer(get("matrix"), "<i4").reshape(len(ids), -1)
            windows = sorted(get("windows"), key=lambda w: w["anchor_id"])
            starts = [k for k in range(len(windows)) if k == 0 or windows[k]["anchor_id"] != windows[k - 1]["anchor_id"]] + [len(windows)]
            for at in range(0, len(starts) - 1, 64):
                some = starts[at : at + 65]
                width = max(len(windows[k]["v"]) for k in some[:-1])
                a = np.zeros((len(some) - 1, max(1, width)), "<i4")
                for row, k in zip(a, some[:-1], strict=True):
                    row[: len(windows[k]["v"])] = windows[k]["v"]
                scores = _product(a, x)
                for s, low, high in zip(scores, some, some[1:], strict=False):
                    first = windows[low]
                    like, other = labels == first["label"], ids != first["anchor_id"]
                    for w in windows[low:high]:
                        keep = (like if w["same"] else ~like) & other & (s >= w["low"]) & (s <= w["high"])
                        if keep.any():
                            yield w, ids[keep], s[keep]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(anchor_id, positive_id, digit, least, most, rows)``: digits from the top, with the scores or ids that a digit stands for."""
    out = []
    for w, ids, s in _scored(batches):
        by_id = w["low"] == w["high"]
        low, high = (w["low_id"], w["high_id"]) if by_id else (w["low"], w["high"])
        if by_id:
            ids = ids[(ids >= low) & (ids <= high)]
        shift = max(0, (high - low).bit_length() - DIGIT)
        # how far from the top, wrapping over the whole range of 64 bits
        far = (ids.view(np.uint64) - np.uint64(low % (1 << 64))) if by_id else (high - s).astype(np.uint64)
        counts = np.bincount((far >> np.uint64(shift)).astype(np.int64))
        reached = int(np.searchsorted(np.cumsum(counts), w["k"] - w["taken"])) + 1
        for d in np.flatnonzero(counts[:reached]).tolist():
            if by_id:
                least = low + (d << shift)
                most = min(high, least + (1 << shift) - 1)
            else:
                most = high - (d << shift)
                least = max(low, most - (1 << shift) + 1)
            out.append({"anchor_id": w["anchor_id"], "positive_id": w["positive_id"], "digit": d, "least": least, "most": most, "rows": int(counts[d])})
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each window up to its last one."""
    out = []
    for w, ids, s in _scored(batches):
        keep = (s > w["low"]) | (ids <= w["high_id"])
        ids, s = ids[keep], s[keep]
        for i in np.lexsort((ids, -s))[: w["k"]].tolist():  # more than k only where rows repeat a vec_id
            out.append({"anchor_id": w["anchor_id"], "positive_id": w["positive_id"], "vec_id": int(ids[i]), "score": int(s[i])})
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out)


def _met(windows: DataFrame, anchors: DataFrame, blocks: DataFrame, n_blocks: int, n_anchors: int) -> DataFrame:
    """Each block of windows with each block of rows, in one row."""
    groups, shares = -(-n_anchors // ANCHORS), -(-n_blocks // SHARE)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    held = windows.join(anchors, "anchor_id").groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int").alias("group"))
    # an anchor's windows are few, so the rows of a group are bounded by its anchors
    packed = held.agg(F.collect_list(F.struct(*WINDOW, "label", "v")).alias("windows")).select("*", each(shares, "share"))
    rows = blocks.select("ids", "labels", "matrix", F.pmod("mark", F.lit(shares)).cast("int").alias("share"), each(groups, "group"))
    return rows.join(packed.hint("merge"), ["group", "share"]).select("ids", "labels", "matrix", "windows")


def radix_select(windows: DataFrame, anchors: DataFrame, blocks: DataFrame, n_blocks: int, n_anchors: int) -> DataFrame:
    """``(anchor_id, positive_id, vec_id, score)``: the first ``k`` rows of every window by score, then vec_id. Written.

    ``windows (anchor_id, positive_id, same, k, floor_score, top_score)`` ask for rows with the
    anchor's label (``same``) or another, whose scores lie between the two, both included.
    """
    ids = blocks_ids(blocks)
    state = windows.select(
        "anchor_id", "positive_id", "same", "k", "floor_score", "top_score", F.col("floor_score").alias("low"), F.col("top_score").alias("high"), F.lit(ids[0]).cast("long").alias("low_id"), F.lit(ids[1]).cast("long").alias("high_id"),
        F.lit(0).cast("long").alias("taken"), F.lit(True).alias("open"),
    )
    state = materialize(state, "negatives-windows")
    while not (asked := state.where("open")).isEmpty():
        counts = _met(asked, anchors, blocks, n_blocks, n_anchors).mapInArrow(_counts, "anchor_id long, positive_id long, digit long, least long, most long, rows long")
        key = Window.partitionBy("anchor_id", "positive_id")
        summed = counts.groupBy("anchor_id", "positive_id", "digit", "least", "most").agg(F.sum("rows").alias("rows")).withColumn("reach", F.sum("rows").over(key.orderBy("digit")))
        hit = state.join(summed, ["anchor_id", "positive_id"]).where("open AND taken + reach >= k AND taken + reach - rows < k").select("anchor_id", "positive_id", F.struct("least", "most", "reach", "rows").alias("hit"))
        by_id, found = F.col("low") == F.col("high"), F.col("hit").isNotNull()
        exact = F.col("taken") + F.col("hit.reach") == F.col("k")
        single = F.col("hit.least") == F.col("hit.most")
        low, high = F.when(found & ~by_id, F.col("hit.least")).otherwise(F.col("low")), F.when(found & ~by_id, F.col("hit.most")).otherwise(F.col("high"))
        # without a bucket for the kth row, all rows of the window are wanted
        goes_on = F.col("open") & found & ~exact & ~(by_id & single)
        after = state.join(hit, ["anchor_id", "positive_id"], "left").select(
            "anchor_id", "positive_id", "same", "k", "floor_score", "top_score", low.alias("low"), high.alias("high"),
            F.when(found & by_id, F.col("hit.least")).otherwise(F.col("low_id")).alias("low_id"), F.when(found & by_id, F.col("hit.most")).otherwise(F.col("high_id")).alias("high_id"),
            F.when(goes_on, F.col("taken") + F.col("hit.reach") - F.col("hit.rows")).otherwise(F.col("taken")).alias("taken"), goes_on.alias("open"),
        )
        before, state = state, materialize(after, "negatives-windows")
        release(before)
    final = state.withColumn("high", F.col("top_score"))  # from the top down to (low, high_id)
    rows = _met(final, anchors, blocks, n_blocks, n_anchors).mapInArrow(_gathered, "anchor_id long, positive_id long, vec_id long, score long")
    out = materialize(rows, "negatives-rows")
    release(state)
    return out


def blocks_ids(blocks: DataFrame) -> tuple[int, int]:
    """The smallest and the largest vec_id."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids in b["ids"]:
                x = np.frombuffer(ids.as_buffer(), "<i8")
                yield pa.RecordBatch.from_pylist([{"low": int(x.min()), "high": int(x.max())}])

    low, high = blocks.select("ids").mapInArrow(ends, "low long, high long").agg(F.min("low"), F.max("high")).first()
    return (low, high) if low is not None else (0, 0)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchors: Column, shift: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on vec_id, ``shift`` the label to use; the negatives of a
    positive score between ``percent`` of its score, both ends included.
    """
    rows = materialize(usable(embeddings, scale, shift), "negatives-vectors")
    blocks = blocks_of(rows)
    n_blocks = blocks.count()
    asked = rows.where(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("one")).select("anchor_id", "one.label", "one.v")
    asked = materialize(asked, "negatives-anchors")
    n_anchors = asked.count()
    norm = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + F.abs(x).cast("long"))
    # no score is beyond the largest component times the anchor's sum of components
    most = max(1, rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0)
    reach = F.greatest(norm(F.col("v")), F.lit(1)) * F.lit(most)
    whole = asked.select("anchor_id", F.lit(-1).cast("long").alias("positive_id"), F.lit(True).alias("same"), F.lit(positives).alias("k"), (-reach).alias("floor_score"), reach.alias("top_score"))
    if not n_blocks or not n_anchors:
        return whole.where("false").select("anchor_id", "positive_id", F.col("k").alias("rank"), F.col("positive_id").alias("negative_id"), F.col("top_score").alias("positive_score"), F.col("top_score").alias("negative_score"))
    found = radix_select(whole, asked, blocks, n_blocks, n_anchors)
    chosen = materialize(_ranked(found, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    release(found)
    # whole hundreds and the rest apart, as score * percent may pass 64 bits
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    least = hundreds * percent[0] + F.expr(f"(pmod(positive_score, 100) * {percent[0]} + 99) div 100")
    highest = hundreds * percent[1] + F.expr(f"(pmod(positive_score, 100) * {percent[1]}) div 100")
    asking = chosen.select("anchor_id", "positive_id", F.lit(False).alias("same"), F.lit(negatives).alias("k"), least.alias("floor_score"), highest.alias("top_score")).distinct().where("floor_score <= top_score")
    got = radix_select(asking, asked, blocks, n_blocks, n_anchors)
    out = _ranked(got, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return out.join(chosen.distinct(), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("vec_id") % 50 == 0, label)


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
                 list_sum(list_transform(range(1, 1 + least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
          FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
chosen AS (SELECT anchor_id, vec_id AS positive_id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
met AS (SELECT c.anchor_id, c.positive_id, p.vec_id AS negative_id, c.score AS positive_score, p.score AS negative_score,
               (row_number() OVER (PARTITION BY c.anchor_id, c.positive_id ORDER BY p.score DESC, p.vec_id))::INT AS rank
        FROM chosen c JOIN pairs p ON p.anchor_id = c.anchor_id AND NOT p.same AND 50 * c.score <= 100 * p.score AND 100 * p.score <= 95 * c.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 3
"""
