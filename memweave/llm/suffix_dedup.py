"""Exact substring dedup by a distributed difference-cover suffix sort.

A byte goes if a ``window``-byte string that covers it also starts earlier: in a text
with a smaller doc_id, or earlier in the same text. Which windows have an earlier
equal is found in three steps, each for all windows that the one before left open. Most
repeats are whole contexts; README has the shares of the steps.

1. Anchors (``anchors.py``) give equal windows equal grams. Windows whose gram occurs
   once have no equal, and never leave their task. Of anchors with equal contexts all
   but the first are repeats as a whole; thousands of copies meet in an aggregation
   with partial results, not in one group. Contexts are told apart by 64-bit hashes of all
   their bytes (XXH3) among those of one gram.
2. What is left (a gram in differing contexts: the ends of passages and the places of
   edits) is cut into units of ``UNIT`` neighbouring windows, aligned by the anchor.
   Units without an equal core drop out, units with equal contexts are settled.
3. The windows that are still open are suffix-sorted by difference cover modulo 3 over
   16-byte characters: triples at the sampled places are sorted and named, the names'
   string is sorted in turn, and the remaining suffixes are merged by first character
   and sampled rank (``suffix_ranks``). Windows with equal neighbours in that order
   are equal; the first of them stays.

Only the suffixes that start open windows are wanted, and to ``window`` bytes, so the
sort keeps of each level just the sampled suffixes that those depend on.

Defined results: a null text is empty; texts shorter than ``window`` lose nothing. Rows
with a null doc_id come after all others. Rows that share a doc_id come in the order of
their texts; rows that repeat doc_id and text are one document with one result. Texts of
any length go: they are read as parts of 2^24 bytes that overlap by a window. Documents and
parts together may be 2^39; more of them fail with a ValueError before any work is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memweave.llm.anchors import GRAM, WINDOW, anchors_of, named, places, prefix_sums, span_hashes
from memweave.llm.batches import slices
from memweave.runtime import materialize, release

UNIT = 4
CHAR = 16
#: A position is one number: that of a text's part above, the byte's in so many low bits.
PART_BITS = 24


I64, I32 = pa.int64(), pa.int32()


def _raw(t: pa.Scalar) -> np.ndarray:
    return np.frombuffer(t.as_py() or b"", np.uint8)


def _rows(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


@dataclass
class Texts:
    """Documents with a number each, in their order."""

    rows: DataFrame  # tid, doc_id, copies, text, units
    simple: bool  # tid is the doc_id itself, and no row repeats another
    stride: int  # numbers from one document to the next; 0 where each takes as many as its units


def numbered(docs: DataFrame, unit_bits: int | None = None) -> Texts:
    """``docs (doc_id, text)`` in order. With ``unit_bits``, a text has a unit for each so many bytes, and a number for each unit."""
    size = F.octet_length("text") if unit_bits else F.lit(0)
    rows, ids, low, high, longest = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id"), F.max(size)).first()
    units = F.greatest(F.ceil(F.coalesce(size, F.lit(0)) / (1 << (unit_bits or 0))), F.lit(1)).cast("long")
    most = max(1, -(-(longest or 0) >> unit_bits) if unit_bits else 1)
    room = 1 << (63 - (unit_bits or 0))
    if rows == ids and (not rows or low >= 0 and (high + 1) * most < room):
        return Texts(docs.select(F.col("doc_id").alias("tid"), "doc_id", F.lit(1).alias("copies"), "text", units.alias("units")), True, most)
    distinct = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull()]
    placed = distinct.withColumn("units", units).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    columns = "at long, part int, units long, doc_id long, copies int, text string"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.record_batch([pa.array(ends - n, I64), *b.columns], names=[c.split()[0] for c in columns.split(", ")])
            at = int(ends[-1]) if len(ends) else at

    placed = materialize(placed.select("part", "units", "doc_id", "copies", "text").mapInArrow(count, columns), "numbered")
    # place in its partition to one number without gaps; a row for each partition on the driver
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("units").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    if before >= room:
        raise ValueError(f"{before} documents and parts; positions hold {room}")
    begin = docs.sparkSession.createDataFrame(starts, "part int, begin long")
    return Texts(placed.join(begin, "part").select((F.col("begin") + F.col("at")).alias("tid"), "doc_id", "copies", "text", "units"), False, 0)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(tid, doc_id, copies, text)`` with tids in the order of documents; whether tid is the doc_id itself."""
    texts = numbered(docs)
    return texts.rows.drop("units"), texts.simple


def _parts(texts: Texts, window: int) -> DataFrame:
    """``(tid, text)``: the units of the texts by their own numbers, as bytes, each with the windows that start in it."""
    raw = F.col("text").cast("binary")
    if texts.stride == 1:
        return texts.rows.select("tid", raw.alias("text"))
    k = F.col("k")
    cut = F.substring(raw, (k * (1 << PART_BITS) + 1).cast("int"), F.lit((1 << PART_BITS) + window - 1))
    first = F.col("tid") * texts.stride if texts.stride else F.col("tid")
    rows = texts.rows.select("tid", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("k"))
    return rows.select((first + k).alias("tid"), F.when(F.col("text").isNotNull(), cut).alias("text"))


def _whole(texts: Texts, runs: DataFrame) -> DataFrame:
    """``(tid, lo, n)`` by document of runs ``(pos, n)`` by part."""
    part, byte = F.shiftright("pos", PART_BITS), F.col("pos").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    if texts.stride == 1:
        return runs.select(part.alias("tid"), byte.alias("lo"), "n")
    if texts.stride:
        owner = F.expr(f"shiftright(pos, {PART_BITS}) div {texts.stride}")
        return runs.select(owner.alias("tid"), (byte + (part - owner * texts.stride) * (1 << PART_BITS)).alias("lo"), "n")
    long = texts.rows.where("units > 1").select("tid", F.explode(F.sequence(F.col("tid"), F.col("tid") + F.col("units") - 1)).alias("part"))
    at = runs.select(part.alias("part"), byte.alias("byte"), "n").join(long, "part", "left").withColumn("tid", F.coalesce("tid", "part"))
    return at.select("tid", (F.col("byte") + (F.col("part") - F.col("tid")) * (1 << PART_BITS)).alias("lo"), "n")


def with_texts(docs: DataFrame, new: DataFrame, doc_id: str, text: str, simple: bool) -> DataFrame:
    """``docs`` with the texts of ``new (doc_id, hash, cut)``; all rows and columns stay, whatever their names."""
    sha = F.lit(None).cast("string") if simple else F.sha2(F.col(text).cast("string"), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), sha.alias("sha"))
    match = F.col("id").eqNullSafe(F.col("doc_id"))
    if not simple:
        match &= F.col("sha") == F.col("hash")
    joined = rows.join(new.hint("merge"), match, "left")
    return joined.select(*[F.coalesce("cut", f"row.`{c}`").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _anchor_rows(docs: DataFrame, window: int, gram: int, full: bool) -> DataFrame:
    """``(gram)``, or ``(pos, n, gram, context)``, of every anchor."""
    names, types = (["pos", "n", "gram", "context"], [I64, I32, I64, I64]) if full else (["gram"], [I64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            tids = b.column(0).to_numpy()
            for k in range(0, len(b), 1000):
                raw = [_raw(t) for t in b.column(1).slice(k, 1000)]
                own, lo, n, g, c = anchors_of(raw, window, gram, full)
                yield _rows(names, types, [(tids[k + own] << PART_BITS) + lo, n.astype(np.int32), g.view(np.int64), c.view(np.int64)] if full else [g.view(np.int64)])

    return docs.select("tid", "text").mapInArrow(run, ", ".join(f"{n} {'int' if t == I32 else 'long'}" for n, t in zip(names, types, strict=True)))


def _hashed(keys: DataFrame) -> DataFrame:
    """``keys``, distinct in what they are joined by, as the side that is hashed: the other side, which is many times larger, is not sorted."""
    return keys.hint("shuffle_hash")


def _split_classes(rows: DataFrame, core: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(pos, n, core, context, ...)`` to: repeats of an equal context; first rows of
    contexts whose core has several contexts; the table of contexts to release.

    Equal contexts have equal lengths and so equal ``n``.
    """
    more = [c for c in rows.columns if c not in ("pos", "n", core, "context")]
    classes = rows.groupBy(core, "context").agg(F.min("pos").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("size"), *[F.min_by(c, "pos").alias(c) for c in more])
    classes = materialize(classes, f"{label}-classes")
    several = classes.where("size > 1").select(core, "context", "first")
    repeats = rows.join(_hashed(several), [core, "context"]).where("pos <> first").select("pos", "n")
    # written before they are joined: both sides are then plain shuffles, and Spark can split a hot one
    many = materialize(classes.groupBy(core).agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select(core), f"{label}-cores")
    open_ = classes.join(_hashed(many), core).select(F.col("first").alias("pos"), "n", *more)
    out = materialize(repeats, f"{label}-repeats"), materialize(open_, f"{label}-open"), classes
    release(many)
    return out


def _text_and_byte() -> list:
    return [F.shiftright("pos", PART_BITS).alias("tid"), F.col("pos").bitwiseAND(F.lit((1 << PART_BITS) - 1)).alias("lo")]


def _segments(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(tid, at, bytes, lo, n)``: the bytes around neighbouring open anchors, and those anchors."""
    names, types = ["tid", "at", "bytes", "lo", "n"], [I64, I64, pa.binary(), pa.list_(I64), pa.list_(I32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for tid, text, lo, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                raw = text.as_py()
                lo, n = np.array(lo.as_py()), np.array(n.as_py())
                order = np.argsort(lo)
                lo, n = lo[order], n[order]
                ends = np.maximum.accumulate(lo + n + window - 1)
                cuts = np.flatnonzero(np.concatenate([[True], lo[1:] > ends[:-1]]))
                for a, z in zip(cuts, [*cuts[1:], len(lo)]):
                    out[0].append(tid)
                    out[1].append(int(lo[a]))
                    out[2].append(raw[lo[a] : ends[z - 1]])
                    out[3].append(lo[a:z])
                    out[4].append(n[a:z])
            yield _rows(names, types, out)

    by = wanted.select(*_text_and_byte(), "n").groupBy("tid").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    return docs.select("tid", "text").join(_hashed(by), "tid").select("tid", "text", "lo", "n").mapInArrow(run, "tid long, at long, bytes binary, lo array<long>, n array<int>")


def _units(segments: DataFrame, window: int, gram: int) -> DataFrame:
    """``(pos, n, core, context, at)`` of every unit of the open anchors' windows."""
    names, types = ["pos", "n", "core", "context", "at"], [I64, I32, I64, I64, I64]

    def units(tids: np.ndarray, ats: np.ndarray, parts: list[np.ndarray], los: list, ns: list) -> list[np.ndarray]:
        """Of segments laid end to end; every window lies in its segment."""
        sizes = np.array([len(x) for x in parts])
        shift = np.cumsum(sizes) - sizes
        raw = np.concatenate(parts)
        count = np.array([len(x) for x in los])
        own = np.repeat(np.arange(len(parts)), count)
        lo, n = np.concatenate(los) - ats[own] + shift[own], np.concatenate(ns)
        w = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(own, n)
        place = places(raw, window, gram)[w]
        slot = (place - w) // UNIT
        new = np.ones(len(w), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (place[1:] != place[:-1]) | (w[1:] != w[:-1] + 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(w)))
        u, left, own = w[first], place[first] - slot[first] * UNIT, own[first]
        core = span_hashes(prefix_sums(raw, 0), left, left - (UNIT - 1) + window, 0)
        context = named(raw, u, u + size - 1 + window)
        return [(tids[own] << PART_BITS) + u - shift[own] + ats[own], size.astype(np.int32), core.view(np.int64), context.view(np.int64), ats[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            tids, ats = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in range(0, len(b), 1000):
                c = [b.column(i).slice(k, 1000) for i in (2, 3, 4)]
                got = units(tids[k : k + 1000], ats[k : k + 1000], [np.frombuffer(x.as_py(), np.uint8) for x in c[0]], *[[np.asarray(x.values) for x in y] for y in c[1:]])
                yield _rows(names, types, got)

    return segments.mapInArrow(run, "pos long, n int, core long, context long, at long")


def _windows(segments: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(id, chars)``: each open window, by its position, as characters of ``CHAR`` bytes."""
    chars = -(-window // CHAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spots, strings = [], []
            for tid, at, data, lo, n in zip(*(b.column(c).to_pylist() for c in (0, 1)), b.column(2), *(b.column(c).to_pylist() for c in (3, 4)), strict=True):
                data = data.as_py()
                for a, m in zip(lo, n, strict=True):
                    for p in range(a, a + m):
                        spots.append((tid << PART_BITS) + p)
                        strings.append(data[p - at : p - at + window].ljust(chars * CHAR, b"\0"))
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CHAR), len(strings) * chars, [None, pa.py_buffer(b"".join(strings))]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(strings) * chars + 1, chars), pa.int32()), cells)
            yield pa.record_batch([pa.array(spots, I64), lists], names=["id", "chars"])

    by = wanted.select(*_text_and_byte(), "n", "at").groupBy("tid", "at").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    return segments.select("tid", "at", "bytes").join(_hashed(by), ["tid", "at"]).select("tid", "at", "bytes", "lo", "n").mapInArrow(run, "id long, chars array<binary>")


def _named(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with the columns ``key`` replaced by a number in their sort order.

    Equal keys are reduced before they are sorted, so a frequent key is one row of the sort.
    """
    distinct = rows.select(*key).distinct()
    ranked = distinct.repartitionByRange(*key).sortWithinPartitions(*key).select(*key, F.monotonically_increasing_id().alias(name))
    ranked = materialize(ranked, "names")  # before use: range bounds are sampled anew in each run
    return rows.join(_hashed(ranked), key).drop(*key)


def suffix_ranks(strings: DataFrame, length: int) -> DataFrame:
    """``(id, rank)`` from ``(id, chars)`` with ``length`` numbers or byte strings each: equal strings get equal
    ranks, and ranks sort as the strings do.

    Difference cover modulo 3: the triples at 1, 4, 7, ... are sorted and named, the string
    of names is ranked by recursion, and the suffix at 0 is merged in as its first
    character with the rank of the suffix at 1. The other sampled residue is only needed to
    merge suffixes at 2 modulo 3, which nobody asks for here.
    """
    if length <= 3:
        last = strings.select("id", *[F.col("chars")[k].alias(f"c{k}") for k in range(length)])
        return _named(last, [f"c{k}" for k in range(length)], "rank").select("id", "rank")
    places_ = list(range(1, length, 3))
    binary = isinstance(strings.schema["chars"].dataType.elementType, T.BinaryType)
    low = F.lit(bytearray()) if binary else F.lit(-(1 << 63)).cast("long")  # the end of a string, before all characters
    at = lambda k: F.col("chars")[k] if k < length else low
    triples = F.array(*[F.struct(F.lit(i).alias("i"), at(k).alias("a"), at(k + 1).alias("b"), at(k + 2).alias("c")) for i, k in enumerate(places_)])
    rows = strings.select("id", F.inline(triples))
    named = _named(rows, ["a", "b", "c"], "name")
    names = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("chars"))
    names = materialize(names, "level")
    ranks = suffix_ranks(names, len(places_))
    merged = strings.select("id", F.col("chars")[0].alias("head")).join(ranks.withColumnRenamed("rank", "tail"), "id")
    out = materialize(_named(merged, ["head", "tail"], "rank").select("id", "rank"), "ranks")
    release(names)
    return out


def _open_repeats(segments: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(pos, n)`` of the open windows that equal an earlier one, by the suffix order."""
    strings = materialize(_windows(segments, wanted, window), "strings")
    ranks = suffix_ranks(strings, -(-window // CHAR))
    first = ranks.groupBy("rank").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    repeats = ranks.join(_hashed(first), "rank").where("id <> first").select(F.col("id").alias("pos"), F.lit(1).alias("n"))
    out = materialize(repeats, "open-repeats")
    release(strings)
    return out


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(pos, n)``: runs of ``n`` windows from ``pos`` on that all have an earlier equal, in ``docs (tid, text)`` with bytes."""
    common = materialize(_anchor_rows(docs, window, gram, False).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "common-grams")
    found = materialize(_anchor_rows(docs, window, gram, True).join(_hashed(common), "gram", "left_semi").select("pos", "n", "gram", "context"), "anchors")
    release(common)
    repeats, open_, classes = _split_classes(found, "gram", "anchor")
    release(classes)
    segments = materialize(_segments(docs, open_, window), "segments")
    units = materialize(_units(segments, window, gram), "units")
    more, left, classes = _split_classes(units, "core", "unit")
    rest = _open_repeats(segments, left, window)
    for done in (found, open_, classes, segments, units, left):
        release(done)
    return repeats.unionByName(more).unionByName(rest)


RESULT = "tid long, doc_id long, copies int, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed_runs(lo: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows starting in [lo, lo+n) cover."""
    order = np.argsort(lo, kind="stable")
    lo, ends = lo[order], np.maximum.accumulate((lo + n + window - 1)[order])
    new = np.concatenate([[True], lo[1:] > ends[:-1]])
    return lo[new], ends[np.concatenate([new[1:], [True]])]


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(raw[a:z] for a, z in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)]))


def _with_runs(texts: Texts, window: int) -> DataFrame:
    """The texts with the lists ``lo`` and ``n`` of their repeated windows, null without any."""
    runs = _whole(texts, repeated_windows(_parts(texts, window), window))
    runs = runs.groupBy("tid").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    return texts.rows.join(_hashed(runs), "tid", "left")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row for each row of ``docs``."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = numbered(narrow, PART_BITS)
    names = ["doc_id", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [I64, I32, I64, I64, I64, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], []]
            for t, lo, n in zip(b.column(2), b.column(3), b.column(4), strict=True):
                raw = (t.as_py() or "").encode()
                starts = ends = np.zeros(0, np.int64)
                if lo.is_valid:
                    starts, ends = _removed_runs(np.array(lo.as_py()), np.array(n.as_py()), window)
                out[0].append(len(raw))
                out[1].append(int((ends - starts).sum()))
                out[2].append(len(starts))
                out[3].append(hashlib.sha256(_kept(raw, starts, ends)).hexdigest())
            yield _rows(names, types, [b.column(0), b.column(1), *out])

    done = _with_runs(texts, window).select("doc_id", "copies", "text", "lo", "n").mapInArrow(run, "doc_id long, copies int, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if not texts.simple:
        done = done.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return done.drop("copies")


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; all columns and rows stay.

    A character is cut if any of its bytes is, so that what is left is text.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = numbered(narrow, PART_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t, lo, n in zip(b.column(2), b.column(3), b.column(4), strict=True):
                raw = (t.as_py() or "").encode()
                out.append(_kept(raw, *_removed_runs(np.array(lo.as_py()), np.array(n.as_py()), window)).decode("utf-8", "ignore"))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], names=["doc_id", "hash", "cut"])

    cut = _with_runs(texts, window).where("lo IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"), "text", "lo", "n").mapInArrow(run, "doc_id long, hash string, cut string")
    return with_texts(docs, cut, doc_id, text, texts.simple)
