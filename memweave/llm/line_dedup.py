"""Line dedup by pairwise alignment.

1. Lines are named by 128 bits of BLAKE2b. A block that two documents share holds runs: the
   shortest neighbouring lines with ``MIN_CHARS`` characters that start, or end, at one of
   its lines, which together cover it. Each document is paired with the first one that has
   a run, so a run in a third of all documents costs one pair a document.
2. Each pair is aligned by patience diff: lines that stand once in both are matched by
   their longest increasing run, the gaps between them in turn, and equal lines at the
   ends of a gap directly.
3. Runs of aligned lines that hold at least ``MIN_CHARS`` characters go from the later
   document. All alignments are made on the input.
4. A run with a line that stayed is open: the first document has it in another order or
   gap. An alignment depends only on the lines that both documents have, so its document is
   paired with all that share one of its rare lines, and of the other holders with the first
   ones of each sequence of its frequent lines. If all of these share rare lines too, it is
   paired with that sequence's other holders. The result is that of all pairs.

Defined results: documents come in the order of doc_id, nulls last; rows that share a
doc_id in the order of their texts; rows that repeat both are one document with one
result. Blank lines make no candidates, but go with a block they stand in. A null text
has no lines, an empty one a single blank line.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memweave.llm.anchors import _powers, span_hashes
from memweave.llm.batches import slices
from memweave.llm.suffix_dedup import keyed, with_texts
from memweave.runtime import materialize, release

MIN_CHARS = 50
KEY = 16
#: A line that more documents with open runs hold is frequent; so many documents stand for a sequence of frequent lines.
RARE, FIRST = 20, 3


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        one, two = Counter(a[i:j]), Counter(b[k:m])
        at = {x: p for p, x in enumerate(b[k:m], k) if two[x] == 1}
        met = [(p, at[x]) for p, x in enumerate(a[i:j], i) if one[x] == 1 and x in at]
        if not met:
            continue
        # longest increasing run of the places in b
        tops: list[int] = []
        last: list[int] = []
        back: list[int] = [-1] * len(met)
        for n, (_, q) in enumerate(met):
            spot = bisect_left(tops, q)
            if spot == len(tops):
                tops.append(q)
                last.append(n)
            else:
                tops[spot], last[spot] = q, n
            back[n] = last[spot - 1] if spot else -1
        run, n = [], last[-1]
        while n >= 0:
            run.append(met[n])
            n = back[n]
        run.reverse()
        out += run
        edges = [(i - 1, k - 1), *run, (j, m)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and end in the second sequence of each run that is aligned without a gap."""
    out: list[list[int]] = []
    before = (-2, -2)
    for i, k in pairs:
        if (i, k) == (before[0] + 1, before[1] + 1):
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
        before = (i, k)
    return [tuple(x) for x in out]


def common_blocks(a: list, b: list, sizes: list[int], min_chars: int) -> list[int]:
    """Places of the lines of ``b`` that stand in a long enough block shared with ``a``."""
    return [k for s, e in blocks(patience(a, b)) if sum(sizes[s:e]) >= min_chars for k in range(s, e)]


def shared_part(a: list, own: set) -> tuple:
    """``a`` with each stretch of lines that are not in ``own`` as one None: aligns with ``own``'s text as ``a`` does."""
    out: list = []
    for x in a:
        if x in own:
            out.append(x)
        elif not out or out[-1] is not None:
            out.append(None)
    return tuple(out)


def _line_table(texts: DataFrame) -> DataFrame:
    """``(tid, keys, sizes)``: each text's line hashes, in one string, and lengths without outer white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, sizes = [], []
            for t in b.column(1):
                lines = t.as_py().split("\n")
                keys.append(b"".join(hashlib.blake2b(x.encode(), digest_size=KEY).digest() for x in lines))
                sizes.append([len(x.strip()) for x in lines])
            yield pa.record_batch([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], names=["tid", "keys", "sizes"])

    return texts.where("text IS NOT NULL").select("tid", "text").mapInArrow(run, "tid long, keys binary, sizes array<int>")


def _cut(keys: bytes) -> list[bytes]:
    return [keys[k : k + KEY] for k in range(0, len(keys), KEY)]


def runs(ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, min_chars: int, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each run, and of each whole document, that has a line not gone.

    ``ids`` and ``sizes`` of the lines of all documents, end to end; ``counts`` of lines.
    Equal runs have equal hashes; the others' collisions cost a pair.
    """
    least, n = max(min_chars, 1), len(ids)
    ends = np.cumsum(counts)
    begins = ends - counts
    own = np.repeat(np.arange(len(counts)), counts)
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    one, two = np.arange(n), np.arange(1, n + 1)
    to = np.searchsorted(sums, sums[:-1] + least, "left")
    since = np.searchsorted(sums, sums[1:] - least, "right") - 1
    ahead, behind = to <= ends[own], since >= begins[own]
    long = sums[ends] - sums[begins] >= least
    start = np.concatenate([one[ahead], since[behind], begins[long]])
    end = np.concatenate([to[ahead], two[behind], ends[long]])
    doc = np.concatenate([own[ahead], own[behind], np.flatnonzero(long)])
    if gone is not None:
        left = np.concatenate([[0], np.cumsum(~gone)])
        keep = left[end] > left[start]
        start, end, doc = start[keep], end[keep], doc[keep]
    up, _ = _powers(n, 0)
    hashes = np.zeros(n + 1, np.uint64)
    np.cumsum(ids * up, out=hashes[1:])
    found = span_hashes(hashes, start, end, 0)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]


def _runs_of(table: DataFrame, min_chars: int) -> DataFrame:
    """``(tid, run)`` of ``table (tid, keys, sizes)``; with a fourth column ``gone``, of the runs that have a line left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64)[::2]
            sizes = b.column(2).flatten().to_numpy()
            counts = b.column(2).value_lengths().to_numpy().astype(np.int64)
            gone = None
            if b.num_columns == 4:
                gone = np.zeros(len(ids), bool)
                lost = b.column(3).value_lengths().fill_null(0).to_numpy()
                gone[np.repeat(np.cumsum(counts) - counts, lost) + b.column(3).flatten().to_numpy()] = True
            doc, found = runs(ids, sizes, counts, min_chars, gone)
            yield pa.record_batch([b.column(0).take(pa.array(doc)), pa.array(found.view(np.int64))], names=["tid", "run"])

    return table.mapInArrow(run, "tid long, run long")


def _aligned(pairs: DataFrame, table: DataFrame, min_chars: int) -> DataFrame:
    """``(tid, k)``: the lines that go from the later document of a pair, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in slices(batches):
            tids, gone = [], []
            for i, (tid, one) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if tid != at:
                    at, two, sizes, known = tid, _cut(b.column(2)[i].as_py()), b.column(3)[i].as_py(), set()
                    own = set(two)
                part = shared_part(_cut(one), own)
                if part in known:
                    continue
                known.add(part)
                if found := common_blocks(part, two, sizes, min_chars):
                    tids.append(tid)
                    gone.append(found)
            yield pa.record_batch([pa.array(tids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["tid", "gone"])

    earlier = table.select(F.col("tid").alias("earlier"), F.col("keys").alias("one"))
    later = table.select(F.col("tid").alias("later"), F.col("keys").alias("two"), "sizes")
    found = pairs.join(earlier, "earlier").join(later, "later").select("later", "one", "two", "sizes").mapInArrow(run, "tid long, gone array<int>")
    # distinct lines first: a document's many partners name the same ones
    return found.select("tid", F.explode("gone").alias("k")).distinct()


def _gathered(lines: DataFrame) -> DataFrame:
    return materialize(lines.groupBy("tid").agg(F.collect_list("k").alias("gone")), "gone")


def _open_runs(table: DataFrame, holders: DataFrame, pairs: DataFrame, gone: DataFrame, min_chars: int) -> DataFrame:
    """``(tid, run, seen)`` of the runs that kept a line after ``pairs``, and have been paired up to the holder ``seen``."""
    tried = pairs.select(F.col("later").alias("tid")).distinct()
    left = _runs_of(table.join(tried, "tid", "left_semi").join(gone, "tid", "left").select("tid", "keys", "sizes", "gone"), min_chars)
    return materialize(left.join(holders, ["tid", "run"]).where("tid > seen").select("tid", "run", "seen"), "open-runs")


def restricted(shape: str, own: str) -> str:
    """A sequence of lines in hex, ``-`` for each stretch of others, with the lines that are not in ``own`` among the others."""
    have = {own[k : k + 2 * KEY] for k in range(0, len(own), 2 * KEY)}
    return re.sub("-+", "-", "".join(x if x in have else "-" for x in re.findall(f"-|[0-9A-F]{{{2 * KEY}}}", shape)))


@F.pandas_udf(StringType())
def _restricted(shapes: pd.Series, own: pd.Series) -> pd.Series:
    return pd.Series([restricted(s, o) for s, o in zip(shapes, own, strict=True)])


def _shapes(lines: DataFrame, some: DataFrame) -> DataFrame:
    """``(tid, shape)`` of ``lines (tid, n, at, line)``: the sequence of the lines that are in ``some (line)``, as ``restricted`` has it."""
    spots = lines.join(some, "line").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("spots"), F.first("n").alias("n"))
    start = F.struct(F.lit(0).alias("next"), F.lit("").alias("s"))
    gap = lambda far: F.when(far, "-").otherwise("")
    put = lambda a, x: F.struct((x["at"] + 1).alias("next"), F.concat(a["s"], gap(x["at"] > a["next"]), F.hex(x["line"])).alias("s"))
    return spots.select("tid", F.aggregate("spots", start, put, lambda a: F.concat(a["s"], gap(a["next"] < F.col("n")))).alias("shape"))


def _other_pairs(table: DataFrame, holders: DataFrame, todo: DataFrame, rare: int, first: int) -> DataFrame:
    """``(earlier, later)``: pairs of the open runs ``todo (tid, run, seen)`` whose alignments are those of all pairs."""
    held = materialize(holders.join(todo.select("run").distinct(), "run").select("tid", "run"), "open-holders")
    cut = F.expr(f"transform(sequence(0, length(keys) div {KEY} - 1), i -> substring(keys, i * {KEY} + 1, {KEY}))")
    lines = table.join(held.select("tid").distinct(), "tid", "left_semi").select("tid", F.expr(f"length(keys) div {KEY}").cast("int").alias("n"), F.posexplode(cut).alias("at", "line"))
    lines = materialize(lines, "open-lines")
    once = lines.select("tid", "line").distinct()
    counts = once.groupBy("line").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("line", (F.col("holders") > rare).alias("often"))
    asked = materialize(once.join(todo.select("tid").distinct(), "tid", "left_semi").join(counts, "line"), "asked-lines")
    few = asked.where("NOT often").select(F.col("tid").alias("later"), "line").join(once.select(F.col("tid").alias("earlier"), "line"), "line")
    few = materialize(few.where("earlier < later").select("earlier", "later").distinct(), "rare-pairs")
    own = asked.where("often").groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), F.hex), "").alias("own"))
    shapes = materialize(held.join(_shapes(lines, asked.where("often").select("line").distinct()), "tid"), "line-shapes")
    open_ = materialize(todo.select(F.col("tid").alias("later"), "run").join(own.withColumnRenamed("tid", "later"), "later"), "open-shapes")

    def firsts(df: DataFrame, *key: str) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("tid"))).where(F.col("place") <= first).drop("place")

    seen = open_.select("run", "own").distinct().join(firsts(shapes, "run", "shape"), "run")
    seen = materialize(seen.select("run", "own", "shape", "tid", _restricted("shape", "own").alias("part")), "seen-shapes")
    some = open_.join(firsts(seen, "run", "own", "part").drop("shape").withColumnRenamed("tid", "earlier"), ["run", "own"]).where("earlier < later")
    some = materialize(some.join(few.withColumn("shares", F.lit(1)), ["earlier", "later"], "left"), "shape-pairs")
    # none of a sequence's first holders has the frequent lines alone in common with the document
    left = some.groupBy("later", "run", "own", "part").agg(F.count(F.lit(1)).alias("n"), F.count("shares").alias("shares")).where((F.col("n") == first) & (F.col("shares") == first))
    rest = left.join(seen.select("run", "own", "part", "shape").distinct(), ["run", "own", "part"]).join(shapes.withColumnRenamed("tid", "earlier"), ["run", "shape"]).where("earlier < later")
    pairs = materialize(reduce(DataFrame.unionByName, (df.select("earlier", "later") for df in (few, some, rest))).distinct(), "more-pairs")
    for df in (held, lines, asked, few, shapes, open_, seen, some):
        release(df)
    return pairs


def _all_removed(table: DataFrame, min_chars: int, rare: int, first: int) -> DataFrame:
    """``(tid, gone)`` of all pairs."""
    held = materialize(_runs_of(table, min_chars), "runs")
    # written before it is joined: both sides are then plain scans, and no hot run is pinned to one task
    shared = materialize(held.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("seen")).where("n > 1").select("run", "seen"), "first-holders")
    holders = materialize(held.join(shared, "run").select("tid", "run", "seen"), "shared-runs")
    release(held)
    release(shared)
    pairs = materialize(holders.where("tid <> seen").select(F.col("seen").alias("earlier"), F.col("tid").alias("later")).distinct(), "pairs")
    gone = _gathered(_aligned(pairs, table, min_chars))
    todo = _open_runs(table, holders, pairs, gone, min_chars)
    release(pairs)
    if not todo.isEmpty():
        pairs = _other_pairs(table, holders, todo, rare, first)
        more = _gathered(_aligned(pairs, table, min_chars).unionByName(gone.select("tid", F.explode("gone").alias("k"))).distinct())
        release(gone)
        release(pairs)
        gone = more
    release(todo)
    release(holders)
    return gone


def removed_lines(texts: DataFrame, min_chars: int = MIN_CHARS, rare: int = RARE, first: int = FIRST) -> DataFrame:
    """``(tid, gone)``: places of the lines that go from each later document."""
    table = materialize(_line_table(texts), "lines")
    out = _all_removed(table, min_chars, rare, first)
    release(table)
    return out


def _without(text: str, gone: list[int]) -> str:
    drop = set(gone)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept_sha256)``, one row for each row of ``docs``."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts, simple = keyed(narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lines, removed, sha = [], [], []
            for t, gone in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                t = t.as_py()
                lines.append(0 if t is None else t.count("\n") + 1)
                removed.append(len(gone or ()))
                sha.append(hashlib.sha256(_without(t or "", gone or []).encode()).hexdigest())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "copies", "n_lines", "n_removed", "kept_sha256"])

    # by sort-merge at any size: the texts move once, and the plan does not turn with the data
    joined = texts.join(removed_lines(texts, min_chars).hint("merge"), "tid", "left").select("doc_id", "copies", "text", "gone")
    out = joined.mapInArrow(run, "doc_id long, copies int, n_lines long, n_removed long, kept_sha256 string")
    if not simple:
        out = out.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.drop("copies")


def remove_lines(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the shared blocks cut out of ``text``; all columns and rows stay."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts, simple = keyed(narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cut = [_without(t.as_py(), gone) for t, gone in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cut, pa.string())], names=["doc_id", "hash", "cut"])

    cut = texts.join(removed_lines(texts, min_chars).hint("merge"), "tid").select("doc_id", F.sha2("text", 256).alias("hash"), "text", "gone").mapInArrow(run, "doc_id long, hash string, cut string")
    return with_texts(docs, cut, doc_id, text, simple)
