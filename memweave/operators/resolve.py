"""Entity, predicate and fact resolution."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memweave.functions import ids, scoring
from memweave.runtime import materialize, release
from memweave.schema import DEFAULT_USER

NEAR = 0.15
FACTS = 10
#: Vectors of a block, of which each two meet in a task.
BLOCK = 1000
#: Cells that nodes are dealt to, at most; the share of them that mentions may meet, by so many of them.
PIVOTS, MOST_MET, SAMPLE = 256, 0.5, 1000
#: Planes of the approximate index: a match at 0.15 is found with 0.989, two random vectors meet with 0.011.
BANDS, BITS = 46, 12


def exact_matches(mentions: DataFrame, nodes: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """``mentions (mention_id, name, node_type)`` with ``by_name`` and ``by_id``: the first node of that
    name and type, and the node with the stable id. ``typed`` are the nodes of the mentions' types, where the caller has them."""
    m = mentions.withColumn("name_key", ids.name_key(F.col("name"))).withColumn("stable", ids.entity_id(F.col("node_type"), F.col("name")))
    named = (nodes if typed is None else typed).where("name_key IS NOT NULL").groupBy("name_key", "node_type").agg(F.min("uuid").alias("by_name"))
    known = nodes.where(F.startswith("uuid", F.lit("entity_"))).select(F.col("uuid").alias("by_id"))  # as stable ids do
    return m.join(named, ["name_key", "node_type"], "left").join(known, F.col("stable") == F.col("by_id"), "left")


def _matrix(vectors, size: int | None = None) -> np.ndarray:
    """Unit vectors as rows; shorter ones are filled with zeros, which is the cosine over the common length."""
    size = size or max(map(len, vectors))
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def named_vectors(*tables: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables with ``vec_id``, a digest, in place of ``embedding``, and ``(vec_id, embedding)`` of them all. Rows without a vector go."""
    named = [df.where("embedding IS NOT NULL").withColumn("embedding", F.col("embedding").cast("array<double>")) for df in tables]
    named = [df.withColumn("vec_id", F.md5(F.col("embedding").cast("string"))) for df in named]
    # vectors are a key of the groups: as a value they would have all rows sorted
    held = reduce(DataFrame.unionByName, [df.select("vec_id", "embedding") for df in named]).distinct()
    return [df.drop("embedding") for df in named], held


def _angles(vectors, pivots: list[list[float]]) -> np.ndarray:
    size = max(max(map(len, vectors)), max(map(len, pivots)))
    return np.arccos(np.clip(_matrix(vectors, size) @ _matrix(pivots, size).T, -1, 1))


def _cells(n: DataFrame, m: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with the ``cell`` of their nearest pivot, mentions with each cell that may hold a match.

    Angles obey the triangle inequality: a node within the threshold of a mention differs
    from it by no more than the threshold's angle in the distance to any pivot. Pivots and
    the span of each cell are what the driver sees, ``PIVOTS`` rows at most. Vectors without
    clusters are near no pivot: where a sample of the mentions meets more than ``MOST_MET`` of the
    cells, there are no cells, and blocks alone meet.
    """
    count = n.count()
    pivots = [r["v"] for r in n.orderBy(F.xxhash64("near_uuid"), "near_uuid").limit(min(PIVOTS, -(-count // BLOCK))).select("v").collect()]
    if len(pivots) < 2 or threshold >= 1:  # a null vector has distance 1 and no angle
        return n.withColumn("cell", F.lit(0)), m.withColumn("cell", F.lit(0))

    @F.pandas_udf("cell int, angle double")
    def own(vectors: pd.Series) -> pd.DataFrame:
        a = _angles(vectors.tolist(), pivots)
        at = a.argmin(1)
        return pd.DataFrame({"cell": at.astype(np.int32), "angle": a[np.arange(len(a)), at]})

    n = materialize(n.withColumn("at", own("v")).select("*", "at.cell", "at.angle").drop("at"), "node-cells")
    spans = {r["cell"]: (r["low"], r["high"]) for r in n.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}
    reach = float(np.arccos(1 - threshold - 10.0**-scoring.DIGITS)) + 1e-6
    cells = np.array(sorted(spans), np.int32)
    low, high = (np.array([spans[c][k] for c in cells]) for k in (0, 1))

    @F.pandas_udf("array<int>")
    def met(vectors: pd.Series) -> pd.Series:
        a = _angles(vectors.tolist(), pivots)[:, cells]
        near = (a - reach <= high) & (a + reach >= low)
        return pd.Series([cells[x].tolist() for x in near])

    some = m.orderBy(F.xxhash64("mention_id")).limit(SAMPLE).select(F.size(met("v")).alias("met"))
    share = (some.agg(F.avg("met")).first()[0] or 0) / len(cells)
    if share > MOST_MET:
        return n.drop("angle").withColumn("cell", F.lit(0)), m.withColumn("cell", F.lit(0))
    return n.drop("angle"), m.withColumn("cell", F.explode(met("v")))


def _banded(df: DataFrame, bands: int, bits: int) -> DataFrame:
    """Each row with a ``cell`` for each band: the sides of random planes that its vector is on."""
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def codes(vectors: pd.Series) -> pd.Series:
        v = _matrix(vectors.tolist())
        # a plane's first components are the same for any length of vectors
        planes = np.stack([np.random.default_rng([17, k]).normal(size=v.shape[1]) for k in range(bands * bits)], 1)
        sides = ((v @ planes) > 0).reshape(len(v), bands, bits) @ weights
        return pd.Series((sides + (np.arange(bands, dtype=np.int64) << bits)).tolist())

    return df.withColumn("cell", F.explode(codes("v")))


def nearest(mentions: DataFrame, nodes: DataFrame, threshold: float = NEAR, exact: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """``(mention_id, near_uuid, distance)``: the nearest node of a mention's type within the threshold.

    One mention and one node, of the smallest id, stand for all of a type and vector. Mentions
    meet the nodes of their type in blocks, as matrix products, and only in the cells where a match can be; each block names the best of each mention. Not
    ``exact``, they meet where they are on the same side of all planes of a band: a match is found
    with 1 - (1 - (1 - angle / 180) ** ``BITS``) ** ``BANDS``, and what is found is measured exactly.

    With ``vectors (vec_id, embedding)``, mentions and nodes have a ``vec_id`` in place of ``embedding``.
    Vectors join what stands for all of a type and vector, so no row is sorted or moved with its own.
    """
    if vectors is None:
        (mentions, nodes), vectors = named_vectors(mentions, nodes)
    vector = vectors.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    alike = ["node_type", "vec_id"]
    told = mentions.where("vec_id IS NOT NULL").select("mention_id", *alike)
    # a few passes follow
    n = materialize(nodes.groupBy(*alike).agg(F.min("uuid").alias("near_uuid")).join(vector, "vec_id").select("near_uuid", "node_type", "v"), "node-vectors")
    met_by = told.select(*alike).distinct().join(vector, "vec_id").select(F.md5(F.to_json(F.struct(*alike))).alias("mention_id"), *alike, "v")
    met_by = materialize(met_by, "mention-vectors")
    m = met_by.drop("vec_id")
    if exact:
        n, m = _cells(n, m, threshold)
    else:
        n, m = (materialize(_banded(df, BANDS, BITS), "bands") for df in (n, m))
    key = ["node_type", "cell"]
    size = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = materialize(size(n, "n_blocks").join(size(m, "m_blocks"), key), "block-counts")

    def dealt(df: DataFrame, own: str, other: str, by: str) -> DataFrame:
        some = df.join(sizes, key).withColumn(own, F.pmod(F.xxhash64(by), F.col(f"{own}s")).cast("int"))
        return some.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("n_blocks", "m_blocks").groupBy(*key, "n_block", "m_block")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("near_uuid", kind="stable")  # the first of equals is the smallest
        a, b = left["v"].tolist(), right["v"].tolist()
        if not a or not b:
            return pd.DataFrame({"mention_id": left["mention_id"][:0], "near_uuid": right["near_uuid"][:0], "distance": np.zeros(0)})
        size = max(max(map(len, a)), max(map(len, b)))
        d = np.round(1 - _matrix(a, size) @ _matrix(b, size).T, scoring.DIGITS) + 0.0
        at = d.argmin(1)
        least = d[np.arange(len(d)), at]
        keep = least <= threshold
        return pd.DataFrame({"mention_id": left["mention_id"].to_numpy()[keep], "near_uuid": right["near_uuid"].to_numpy()[at[keep]], "distance": least[keep]})

    met = dealt(m, "m_block", "n_block", "mention_id").cogroup(dealt(n, "n_block", "m_block", "near_uuid")).applyInPandas(best, "mention_id string, near_uuid string, distance double")
    met = met.groupBy("mention_id").agg(F.min(F.struct("distance", "near_uuid")).alias("b")).join(met_by.select("mention_id", *alike), "mention_id").drop("mention_id")
    return told.join(met, alike).groupBy("mention_id").agg(F.min("b").alias("b")).select("mention_id", "b.near_uuid", "b.distance")


def resolve(mentions: DataFrame, nodes: DataFrame, threshold: float = NEAR, vectors: DataFrame | None = None) -> DataFrame:
    """``(mention_id, uuid, how)`` of ``mentions (mention_id, name, node_type, embedding)``.

    SELF is the node of the mention's ``user_id`` (the default user without the column); a
    generated id must be a node's and is never created (``missing``); an empty name has no
    node (``empty``). All others: by vector, then name, then stable id, else new under that id.

    Mentions without a vector column match by name and id alone.
    A name and type meets the nodes once, however many mention it, and only nodes of the mentions'
    types are looked through for names and vectors. ``vectors`` as in ``nearest``.
    """
    clean = ids.strip(F.coalesce("name", F.lit("")))
    m = mentions.withColumn("name", clean).withColumn("me", F.upper("name") == "SELF").withColumn("strict", ids.is_generated_id(F.col("name")))
    if "user_id" not in m.columns:
        m = m.withColumn("user_id", F.lit(DEFAULT_USER))
    named = m.where("NOT me AND NOT strict AND name <> ''")
    terms = m.select("name", "node_type", "strict").distinct()
    kinds = materialize(terms.select("node_type").distinct(), "mention-types")  # few, so that Spark knows their size
    typed = nodes.join(kinds, "node_type", "left_semi")
    known = nodes.where(ids.is_generated_id(F.col("uuid"))).select(F.col("uuid").alias("as_id"))
    met = exact_matches(terms, nodes, typed).join(known, F.col("strict") & (F.col("name") == F.col("as_id")), "left")
    met = met.select(F.col("name").alias("of_name"), F.col("node_type").alias("of_type"), "by_name", "by_id", "stable", "as_id")
    with_vectors = vectors is not None or "embedding" in mentions.columns
    near = nearest(named, typed, threshold, vectors=vectors) if with_vectors else m.limit(0).select("mention_id", F.col("name").alias("near_uuid"))
    out = m.join(met, (F.col("name") == F.col("of_name")) & F.col("node_type").eqNullSafe(F.col("of_type"))).join(near, "mention_id", "left")
    how = (
        F.when(F.col("name") == "", "empty").when(F.col("me"), "self").when(F.col("strict"), F.when(F.col("as_id").isNotNull(), "strict").otherwise("missing"))
        .when(F.col("near_uuid").isNotNull(), "vector").when(F.col("by_name").isNotNull(), "name").when(F.col("by_id").isNotNull(), "id").otherwise("new")
    )
    uuid = F.when(F.col("name") == "", None).when(F.col("me"), ids.self_id(F.col("user_id"))).when(F.col("strict"), F.col("as_id")).otherwise(F.coalesce("near_uuid", "by_name", "stable"))
    return out.select("mention_id", uuid.alias("uuid"), how.alias("how"))


def _links(items: DataFrame, threshold: float) -> DataFrame:
    """``(e, l, distance)`` of all pairs of ``items (node_type, at, embedding)`` of one type within the threshold, in order.

    Blocks meet as matrix products, each two in a task of their own.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).cast("int").alias("size")
    held = items.where("embedding IS NOT NULL").join(items.groupBy("node_type").agg(size), "node_type")
    held = held.withColumn("block", F.pmod(F.xxhash64("at.stable"), F.col("size")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("other")
    dealt = held.select("node_type", "at", "embedding", "block", other).select("node_type", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "at.pos", "at.stable", "embedding")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(pdf["embedding"].tolist())
        one, two = (np.flatnonzero(pdf["block"] == pdf[k].iloc[0]) for k in ("one", "two"))
        d = np.round(1 - v[one] @ v[two].T, scoring.DIGITS)
        i, k = np.nonzero(d <= threshold)
        keep = one[i] < two[k] if pdf["one"].iloc[0] == pdf["two"].iloc[0] else slice(None)
        x, y = pdf.iloc[one[i][keep]], pdf.iloc[two[k][keep]]
        return pd.DataFrame({"ap": x["pos"].to_numpy(), "a": x["stable"].to_numpy(), "bp": y["pos"].to_numpy(), "b": y["stable"].to_numpy(), "distance": d[i, k][keep]})

    pos = items.select("at.pos").schema["pos"].dataType.simpleString()
    found = dealt.groupBy("node_type", "one", "two").applyInPandas(near, f"ap {pos}, a string, bp {pos}, b string, distance double")
    x, y = F.struct(F.col("ap").alias("pos"), F.col("a").alias("stable")), F.struct(F.col("bp").alias("pos"), F.col("b").alias("stable"))
    return found.select(F.least(x, y).alias("e"), F.greatest(x, y).alias("l"), "distance")


def _leaders(items: DataFrame, links: DataFrame) -> DataFrame:
    """``(at)`` of the items that no earlier leader is linked to. A round decides all whose earlier neighbours are decided."""
    nodes, live = items.select("at"), links.select("e", "l")
    parts = []
    while not nodes.isEmpty():
        free = materialize(nodes.join(live, F.col("at") == F.col("l"), "left_anti"), "leaders")
        parts.append(free)
        dead = materialize(live.join(free, F.col("e") == F.col("at"), "left_semi").select(F.col("l").alias("at")).distinct(), "followers")
        last = nodes, live
        nodes = materialize(nodes.join(free.unionByName(dead), "at", "left_anti"), "undecided")
        of = lambda k: F.col(k) == F.col("at")
        live = materialize(live.join(nodes, of("e"), "left_semi").join(nodes, of("l"), "left_semi"), "live-links")
        for df in (dead, *last):
            if hasattr(df, "written_at"):
                release(df)
    return reduce(DataFrame.unionByName, parts) if parts else items.select("at")


def greedy_resolution(mentions: DataFrame, threshold: float = NEAR) -> DataFrame:
    """``(mention_id, uuid)`` where an earlier mention may be the match of a later one.

    ``mentions (mention_id, pos, name, node_type, embedding)``. Types never match each
    other, and mentions with equal stable id are reduced first. In order of ``pos``, a
    mention without an earlier leader within the threshold is a leader; any other goes to
    the nearest earlier leader, the first of equals. Only the first mention of a vector can
    lead, so vectors are compared once. Without a vector a mention is its own leader.
    """
    keyed = mentions.withColumn("stable", ids.entity_id(F.col("node_type"), F.col("name")))
    first = keyed.groupBy("node_type", "stable").agg(F.min(F.struct("pos", "embedding")).alias("m"))
    vector = F.col("m.embedding").cast("array<double>")
    same = F.exists(vector, lambda x: x != 0) & ~F.exists(vector, F.isnan) & F.lit(threshold >= 0)
    kind = F.when(same, F.sha2(F.concat_ws(":", "node_type", vector.cast("string")), 256)).otherwise(F.col("stable"))
    first = materialize(first.select("node_type", F.struct("m.pos", "stable").alias("at"), kind.alias("kind"), vector.alias("embedding")), "mentions")
    items = materialize(first.groupBy("kind").agg(F.min(F.struct("at", "node_type", "embedding")).alias("i")).select("kind", "i.*"), "vectors")
    links = materialize(_links(items, threshold), "near-links")
    leaders = materialize(_leaders(items, links), "all-leaders")
    both = links.select(F.col("e").alias("at"), F.col("l").alias("to"), "distance").unionByName(links.select(F.col("l").alias("at"), F.col("e").alias("to"), "distance"))
    own = leaders.select("at", F.col("at").alias("to"), F.lit(0.0).alias("distance"))
    met = both.join(leaders.select(F.col("at").alias("to")), "to", "left_semi").select("at", "to", "distance").unionByName(own)
    met = met.join(items.select("at", "kind"), "at").select("kind", "to", "distance")
    best = first.select("kind", "at").join(met, "kind").where("to <= at").groupBy("at").agg(F.min(F.struct("distance", "to")).alias("b"))
    return keyed.join(best.select("at.stable", F.col("b.to.stable").alias("uuid")), "stable").select("mention_id", "uuid")


def resolve_terms(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """``terms (term_id, term, node_type, user_id)`` with ``text``, ``uuid``, ``resolved_type``, ``rejected``.

    SELF is the user's own node; placeholders are rejected; a generated id becomes its
    node's content, or is rejected where that is missing, blank or an id itself. Other columns
    of ``terms`` stay. Only ids meet the nodes: all else, SELF of every user too, is no key of a join.
    """
    t = terms.withColumn("bare", ids.strip(F.coalesce("term", F.lit(""))))
    n = nodes.select(F.col("uuid").alias("ref"), ids.strip(F.coalesce("content", F.lit(""))).alias("body"), F.col("node_type").alias("ref_type"))
    own = [c for c in terms.columns if c not in ("term_id", "term", "node_type", "user_id")]
    me = F.upper("bare") == "SELF"
    nothing = (F.col("bare") == "") | ids.is_placeholder(F.col("bare"), F.col("node_type"))
    is_id = ids.is_generated_id(F.col("bare"))
    none = [F.lit(None).cast("string").alias(c) for c in ("ref", "body", "ref_type")]
    j = t.where(is_id).join(n, F.col("bare") == F.col("ref"), "left").unionByName(t.where(~is_id).select("*", *none))
    lost = is_id & (F.col("body").isNull() | (F.col("body") == "") | ids.is_generated_id(F.col("body")))
    bad = ~me & (nothing | lost)
    return j.select(
        "term_id",
        F.when(bad, None).when(me, F.lit("Me")).when(is_id, F.col("body")).otherwise(F.col("bare")).alias("text"),
        F.when(bad, None).when(me, ids.self_id(F.col("user_id"))).when(is_id, F.col("ref")).alias("uuid"),
        F.when(bad, None).when(me, F.lit("person")).when(is_id, F.col("ref_type")).alias("resolved_type"),
        bad.alias("rejected"),
        *own,
    )


def supersede_candidates(facts: DataFrame, edges: DataFrame, newest: int = FACTS) -> DataFrame:
    """``(fact_uuid, candidate_uuid, rank)``: a subject's newest facts, dead ones among them, less the fact itself.

    ``facts (uuid, user_id, subject_uuid)``. The fact takes up a place before it is left out.
    """
    rank = F.row_number().over(Window.partitionBy("user_id", "subject_uuid").orderBy(F.desc("updated_at"), "uuid"))
    mine = edges.join(facts.select("user_id", "subject_uuid").distinct(), ["user_id", "subject_uuid"], "left_semi")
    top = mine.withColumn("rank", rank).where(F.col("rank") <= newest).where(F.length(F.trim("content")) > 0)
    f = facts.select(F.col("uuid").alias("fact_uuid"), "user_id", "subject_uuid")
    return f.join(top.select("user_id", "subject_uuid", F.col("uuid").alias("candidate_uuid"), "rank"), ["user_id", "subject_uuid"]).where("fact_uuid <> candidate_uuid").select("fact_uuid", "candidate_uuid", "rank")
