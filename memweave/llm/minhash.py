"""Near duplicates: MinHash signatures, banding, verification, connected components.

1. Every text gives the name of its word sequence (128 bits of BLAKE2b), its set's size
   and ``BANDS * ROWS`` universal hash minima. Equal sequences are one class from here on,
   so thousands of copies cost one signature.
2. Classes meet in the buckets of their bands. Rather than all pairs of a bucket, each
   class is paired with the bucket's pivot, the one that meets the most others; a pair that the signatures leave possible is
   confirmed on the full sets, and the confirmed links are closed by large-star and
   small-star. Two classes of one component need no comparison.
3. Classes of buckets that still hold several components go on to an exact search: a
   similar pair must share one of the rarest shingles of each set, early enough for the
   rest to suffice (prefix and position filter). Pairs of different components that do
   are confirmed, for two components the likeliest pair first, and join their components.
   So the number of pairs follows what can still be linked, not the square of a bucket.

A pair at the threshold of 0.8 shares none of the 40 bands of 5 rows with a chance of
1.3e-7, and more similar pairs with less. Signatures reject only pairs whose estimate
is 0.6 or less: seven standard deviations below 0.8. "Rarest" is by a table of
2 ** ``SKETCH_BITS`` counters, of one size for any corpus; a coarser table makes more pairs, but
loses none, as any order that all sets share is valid for the filter.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing. Rows with one doc_id and several texts are several documents; a component's
id is its smallest doc_id that is not null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memweave.llm.batches import slices
from memweave.llm.components import connected_components
from memweave.llm.shingles import minima, permutations, shingle_set, similar, similar_words, text_key, word_shingles, words
from memweave.runtime import materialize, release

BANDS, ROWS = 40, 5
LEAST_ESTIMATE = 0.6
#: Bits of a shingle that choose its counter.
SKETCH_BITS = 20


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, key, n_shingles, digest, signature, bands)``; key, signature and bands are null without shingles."""
    a, b = permutations(bands * rows)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.random.default_rng(11).integers(0, 1 << 64, (bands, rows), dtype=np.uint64) | np.uint64(1)
        for batch in slices(batches):
            keys, sizes, digests, signs, buckets = [], [], [], [], []
            for t in batch.column(1):
                t = t.as_py()
                own = words(t)
                s = shingle_set(own, k)
                digests.append(hashlib.sha256((t or "").encode()).digest())
                keys.append(text_key(own))
                sizes.append(len(s))
                if not len(s):
                    signs.append(None)
                    buckets.append(None)
                    continue
                m = minima(s, a, b)
                signs.append(m.tobytes())
                h = (m.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * salt
                h ^= h >> np.uint64(29)
                buckets.append(((h * salt[:, ::-1]).sum(1) + np.arange(bands, dtype=np.uint64) * salt[:, 0]).view(np.int64))
            yield pa.record_batch([batch.column(0), *(pa.array(c, t.type) for c, t in zip((keys, sizes, digests, signs, buckets), list(schema)[1:], strict=True))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, key binary, n_shingles long, digest binary, signature binary, bands array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(a, b, same)`` of the pairs of keys whose signatures agree in more than ``LEAST_ESTIMATE`` of the minima."""
    least = LEAST_ESTIMATE * bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if len(b):
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(len(b), -1) for c in (2, 3))
                same = (x == y).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same.astype(np.int32))], names=["a", "b", "same"]).filter(pa.array(same > least))

    of = lambda side: classes.select(F.col("key").alias(side), F.col("signature").alias(f"sign_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a binary, b binary, same int")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of keys whose full sets are similar, as links ``(u, v)``. What the hashed sets promise is counted again on the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, two, its_hashes, its_words = None, "", np.zeros(0, np.uint64), set()  # a pivot's set serves many rows
        for b in slices(batches):
            good = []
            for y, one, other in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if at != y:
                    at, two = y, zlib.decompress(other.as_py()).decode()
                    its_hashes, its_words = shingle_set(two, k), set()
                one = zlib.decompress(one.as_py()).decode()
                hit = similar(shingle_set(one, k), its_hashes, percent)
                if hit:
                    its_words = its_words or word_shingles(two, k)
                    hit = similar_words(word_shingles(one, k), its_words, percent)
                good.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    of = lambda side: texts.select(F.col("key").alias(side), F.col("packed").alias(f"text_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "u binary, v binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, packed)``: one compressed text for each wanted ``(key, doc_id)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, packed = [], []
            for t in b.column(0):
                t = t.as_py() or ""
                keys.append(text_key(words(t)))
                packed.append(zlib.compress(t.encode(), 1))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["key", "packed"])

    ids = wanted.select("doc_id").distinct()
    found = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text").mapInArrow(run, "key binary, packed binary")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(sets: DataFrame, k: int) -> np.ndarray:
    """How many shingles of ``sets (packed)`` fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in slices(batches):
            for t in b.column(0):
                np.add.at(counts, _slots(shingle_set(zlib.decompress(t.as_py()).decode(), k)), 1)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    got = sets.select("packed").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _prefixes(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """``(token, key, component, n, pos)``: the rarest shingles of each set, of which a similar set has one."""
    shared = sets.sparkSession.sparkContext.broadcast(_sketch(sets, k))
    names = ["token", "key", "component", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in slices(batches):
            found, sizes, places = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            for t in b.column(2):
                s = shingle_set(zlib.decompress(t.as_py()).decode(), k)
                size = len(s) - -(-percent * len(s) // 100) + 1
                found.append(s[np.lexsort((s, counts[_slots(s)]))[:size]])
                sizes.append(len(s))
                places.append(np.arange(size))
            own = np.repeat(np.arange(len(b)), [len(x) for x in places[1:]])
            keys, components = (b.column(c).take(pa.array(own)) for c in (0, 1))
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), keys, components, pa.array(np.array(sizes, np.int64)[own]), pa.array(np.concatenate(places))], names=names)

    return sets.select("key", "component", "packed").mapInArrow(run, "token long, key binary, component binary, n long, pos long")


def _open_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """``(a, b, of_a, of_b)``: pairs of different components that may be similar by their rarest shingles.

    A token's heaviest component is met only by the classes of others, never by its own: many near copies
    that share a token cost their number times that of the strangers.
    """
    sizes = prefixes.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    heavy = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("h"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", F.col("h.component").alias("heavy"))
    rows = materialize(prefixes.join(heavy, "token").withColumn("light", F.col("component") != F.col("heavy")), "mixed")
    x, y = rows.where("light").alias("x"), rows.alias("y")
    both = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent))  # what similar sets of these sizes share
    fits = (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= both)
    once = ~F.col("y.light") | (F.col("x.key") < F.col("y.key"))
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & once & fits)
    a, b = (F.struct(F.col(f"{s}.key").alias("key"), F.col(f"{s}.component").alias("of")) for s in ("x", "y"))
    found = found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    out = materialize(found.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.col("a.of").alias("of_a"), F.col("b.of").alias("of_b")), "open")
    release(rows)
    return out


def _joined(pairs: DataFrame, confirm: Callable[[DataFrame], DataFrame], likely: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(component, top)`` by confirmed links among ``pairs (a, b, of_a, of_b)`` of different components.

    Of two components, the pair that the signatures find most alike is confirmed first. Where that
    joins them no other pair of theirs needs a look; all the rest are confirmed next.
    """
    able = materialize(pairs.join(likely(pairs.select("a", "b")), ["a", "b"]), "likely")
    sides = [F.least("of_a", "of_b").alias("low"), F.greatest("of_a", "of_b").alias("high")]
    best = able.groupBy(*sides).agg(F.max_by(F.struct("a", "b"), F.struct("same", "a", "b")).alias("p")).select("p.a", "p.b")
    names = able.select("a", "b", "of_a", "of_b")
    of_links = lambda links: links.join(names, (F.col("u") == F.col("a")) & (F.col("v") == F.col("b"))).select(F.col("of_a").alias("u"), F.col("of_b").alias("v"))
    first = materialize(connected_components(of_links(confirm(best))), "joined")
    top = lambda side: first.select(F.col("node").alias(f"of_{side}"), F.col("component").alias(f"top_{side}"))
    placed = able.join(top("a"), "of_a", "left").join(top("b"), "of_b", "left").withColumn("x", F.coalesce("top_a", "of_a")).withColumn("y", F.coalesce("top_b", "of_b"))
    rest = placed.where("x <> y").select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti")
    links = first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(of_links(confirm(rest)))
    out = materialize(connected_components(links), "all-joined")
    for done in (able, first):
        release(done)
    return out.select(F.col("node").alias("component"), F.col("component").alias("top"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``."""
    return _verdicts(*_grouped(docs, k, percent, doc_id, text, bands, rows))


def remove_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, nulls last, then of the smallest text digest.

    Rows that repeat its doc_id and text go as well; texts without a word stay, each row of them.
    """
    rows, placed = _grouped(docs, k, percent, doc_id, text, BANDS, ROWS)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("b")
    kept = rows.join(placed.select("key", "component"), "key").groupBy("component").agg(best).select(F.col("b.doc_id").alias("kept_id"), F.col("b.digest").alias("kept_digest"))
    kept = materialize(kept, "kept")
    wordless = F.coalesce(~F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    digest = F.unhex(F.sha2(F.col(text).cast("string"), 256))
    some = docs.where(~wordless).select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), digest.alias("digest"))
    found = some.join(kept, some["id"].eqNullSafe(kept["kept_id"]) & (some["digest"] == kept["kept_digest"]), "left_semi")
    return docs.where(wordless).unionByName(found.dropDuplicates(["id", "digest"]).select("row.*"))


def _grouped(docs: DataFrame, k: int, percent: int, doc_id: str, text: str, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, key, n_shingles, digest)`` of all rows, and ``(key, doc_id, component)`` of all classes."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = materialize(signatures(docs, k, bands, rows), "signed")
    classes = materialize(
        signed.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")),
        "classes",
    )
    # signatures are most of the disk: from here on, rows and classes go by their keys
    rows_of = materialize(signed.select("doc_id", "key", "n_shingles", "digest"), "rows")
    release(signed)
    named = materialize(classes.select("key", "doc_id"), "named")
    spread = classes.select("key", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(spread.join(shared, "bucket"), "members")
    wanted = materialize(classes.select("key", "doc_id", "signature").join(members.select("key").distinct(), "key"), "wanted")
    release(classes)
    texts = materialize(_texts(docs, wanted.select("key", "doc_id")), "texts")

    def likely(pairs: DataFrame) -> DataFrame:
        return _likely(pairs, wanted, bands, rows)

    def confirm(pairs: DataFrame) -> DataFrame:
        return materialize(_confirmed(pairs, texts, k, percent), "confirmed")

    # a bucket's pivot is its class that meets the most others: near copies then share one pivot in all their buckets
    weights = members.groupBy("key").agg(F.sum("size").alias("weight"))
    pivots = members.join(weights, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("p")).select("bucket", F.col("p.key").alias("pivot"))
    pivots = materialize(pivots, "pivots")
    first = members.join(pivots, "bucket").where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    links = confirm(likely(first).drop("same"))
    labels = materialize(connected_components(links), "labels")
    placed = members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
    mixed = materialize(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket"), "mixed-buckets")
    open_ = materialize(placed.join(mixed, "bucket").select("key", "component").distinct(), "open-classes")
    sets = materialize(open_.join(texts, "key"), "open-sets")
    prefixes = materialize(_prefixes(sets, k, percent), "prefixes")
    # the new links join whole components
    higher = _joined(_open_pairs(prefixes, percent), confirm, likely)
    for done in (members, pivots, sets, prefixes, texts, wanted):
        release(done)
    placed = named.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("component"))
    placed = placed.join(higher, "component", "left").select("key", "doc_id", F.coalesce("top", "component").alias("component"))
    return rows_of, placed


def _verdicts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    ids = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = materialize(placed.select("key", "component").join(ids, "component").select("key", "component_id"), "verdicts")
    out = rows.join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: The rows of ``near_duplicates`` with ``k=4`` and ``percent=80``, by brute force over shared shingles.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d WHERE r.c < e.y)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, d = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""
