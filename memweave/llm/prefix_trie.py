"""Prefix trie of conversations, built level by level.

Going down, the live conversations of a level are grouped by (node above, next turn); the
smallest conv_id of a group names the node. A conversation lives on while it has a next
turn and shares its node: one that is alone can only go on as a chain of single nodes,
which needs no rounds. The first ``SINGLY`` levels are rounds of their own. Below them a
round takes 2, 4, .. ``WIDEST`` levels at once: a conversation carries a digest for each
level of the stretch, chained from turn to turn, and a group is (node above the stretch,
level, chained digest), so that long shared prefixes take few rounds.

Coming back, each stretch, deepest first, is joined with the totals of the one below:
leaves and savings of a node are its own and those of its children.

Turns are numbered without a task for each conversation: rows are range-partitioned by
(conv_id, turn), numbered within a partition, and shifted by what earlier partitions hold
of the conversation. Groups are counted with partial results, and their names go back to
the members by joins that Spark can split. Rounds are written tables.

Defined results: turns are ordered by turn, null first; rows that tie are ordered by a
digest of role and text, and repeated rows are turns of their own. Null role or text is
empty. Rows without a conv_id take no part. Two turns are the same if role and text are,
by SHA-256 over both with the role's length. Savings count code points. An empty table has
no node. Columns other than the four named pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memweave.llm.batches import slices
from memweave.runtime import materialize, release

SINGLY, WIDEST = 8, 64
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """32 bytes that name a turn."""
    return F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)).cast("binary"), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, key, chars``: turns numbered from 1 in each conversation. Written."""
    c = {k: F.col(k) for k in ("conv_id", "turn", "role", "text")}
    role, text = F.coalesce(c["role"], F.lit("")), F.coalesce(c["text"], F.lit(""))
    turns = conversations.where(c["conv_id"].isNotNull()).select(c["conv_id"].cast("long").alias("conv_id"), c["turn"], turn_key(role, text).alias("key"), F.char_length(text).cast("long").alias("chars"))
    turns = turns.withColumn("row", F.monotonically_increasing_id())  # repeated rows can be dealt to several partitions
    dealt = materialize(turns.repartitionByRange("conv_id", "turn", "key", "row").withColumn("part", F.spark_partition_id()), "trie-dealt")
    in_part = Window.partitionBy("part", "conv_id")
    parts = dealt.groupBy("conv_id", "part").count()
    before = parts.select("conv_id", "part", (F.sum("count").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("count")).alias("before"))
    placed = dealt.withColumn("nth", F.row_number().over(in_part.orderBy(F.col("turn").asc_nulls_first(), "key", "row")))
    out = materialize(placed.join(before, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("nth")).alias("pos"), "key", "chars"), "trie-turns")
    release(dealt)
    return out


def rebuilt(turns: DataFrame, heads: int, family: int) -> DataFrame:
    """Every conversation with the first turns of its family's base in place of its own. Written.

    The base of c is c - c % ``family``; h = crc32(decimal c) % ``heads`` of its turns come
    first, then what c has after its first h. A conversation left without turns stays as
    a row with pos 0.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("turns"))
    base = lengths.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = lengths.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(base, "base", "left")
    convs = materialize(convs.withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))), "trie-convs")
    head = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    first = convs.join(head, "base").where("pos <= h").select("conv_id", "pos", "key", "chars")
    own = turns.where(F.col("pos") > h).join(convs.select("conv_id", "h", "taken"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars")
    none = convs.where("taken = 0 AND turns <= h").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))
    out = materialize(first.unionByName(own).unionByName(none), "trie-rebuilt")
    release(convs)
    return out


def _chained(rows: DataFrame) -> DataFrame:
    """``link`` for each row of a stretch: a digest of the stretch's turns up to the row's."""
    follow = lambda done, turn: F.concat(done, F.array(F.unhex(F.sha2(F.concat(F.element_at(done, -1), turn["key"]), 256))))
    listed = rows.groupBy("conv_id", "above", "last").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("turns"))
    links = F.slice(F.aggregate("turns", F.array(F.lit(b"")), follow), 2, F.size("turns"))
    return listed.select("conv_id", "above", "last", F.inline(F.arrays_zip(F.col("turns.pos").alias("pos"), F.col("turns.chars").alias("chars"), links.alias("link"))))


def _down(live: DataFrame, turns: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """The levels ``start + 1`` to ``end`` below the nodes of ``live (conv_id, above, last)``.

    Returns the members ``(conv_id, last, pos, node, n_convs)`` and the nodes ``(depth,
    conv_id, parent_conv_id, n_convs, chars)``, both written; ``last`` is a member's length.
    """
    rows = turns.where((F.col("pos") > start) & (F.col("pos") <= end)).join(live, "conv_id")
    rows = rows.withColumnRenamed("key", "link") if end == start + 1 else _chained(rows)
    groups = rows.groupBy("above", "pos", "link").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"))
    members = materialize(rows.join(groups, ["above", "pos", "link"]).select("conv_id", "last", "above", "pos", "chars", "node", "n_convs"), "trie-members")
    parent = F.when(F.col("pos") == start + 1, F.col("above")).otherwise(F.lag("node").over(Window.partitionBy("conv_id").orderBy("pos"))) if end > start + 1 else F.col("above")
    nodes = members.withColumn("parent_conv_id", parent).where("conv_id = node").select(F.col("pos").alias("depth"), "conv_id", "parent_conv_id", "n_convs", "chars")
    return members, materialize(nodes, "trie-nodes")


def _up(members: DataFrame, nodes: DataFrame, below: DataFrame | None, end: int) -> DataFrame:
    """``nodes`` with ``n_children, n_leaves, saved_tokens``. Written.

    ``below`` has the finished nodes of the level after ``end`` whose parents still live;
    members that are alone at ``end`` and go on are chains of one leaf.
    """
    inner = nodes.select((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    chains = members.where((F.col("pos") == end) & (F.col("n_convs") == 1) & (F.col("last") > end)).select(F.col("pos").alias("depth"), "conv_id", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    under = inner.unionByName(chains)
    if below is not None:
        under = under.unionByName(below.where(F.col("depth") == end + 1).select((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    children = under.groupBy("depth", "conv_id").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    known = nodes.join(children, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    # what a node adds itself: a leaf if it has no child, its saving, and all from below the stretch
    own = known.select(
        "depth", F.col("conv_id").alias("node"),
        (F.when(F.col("n_children") == 0, 1).otherwise(0) + F.coalesce("leaves", F.lit(0))).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).alias("saved"),
    )
    if end > nodes.first_level:
        # of each member: what the nodes named by it add from each level of the stretch on
        named = own.withColumnsRenamed({"node": "conv_id", "depth": "pos"})
        rest = Window.partitionBy("conv_id").orderBy(F.col("pos").desc())
        each = members.join(named, ["conv_id", "pos"], "left").select(F.col("pos").alias("depth"), "node", F.sum(F.coalesce("leaves", F.lit(0))).over(rest).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).over(rest).alias("saved"))
        own = each.groupBy("depth", "node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = own.select("depth", F.col("node").alias("conv_id"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return materialize(known.select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children").join(totals, ["depth", "conv_id"]), "trie-totals")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its parts, which follow one another; a node in hand is all that is kept."""
    at, state = None, None

    def row():
        return pa.RecordBatch.from_pylist([{"depth": at[0], "conv_id": at[1], "ends_sha256": state.hexdigest()}], schema=pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())]))

    for b in slices(batches):
        out = []
        for depth, node, part in zip(b["depth"].to_pylist(), b["conv_id"].to_pylist(), b["part"].to_pylist(), strict=True):
            if (depth, node) != at:
                if at:
                    out.append(row())
                at, state = (depth, node), hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield from out
    if at:
        yield row()


def ends_digest(ends: DataFrame) -> DataFrame:
    """``ends (depth, node, member)`` to a digest of each node's members in order, comma-joined.

    Members are sorted over the cluster and joined to strings part by part; a digest is
    one sequence of bytes by its nature, so a node's parts then pass one task as a stream.
    """
    dealt = materialize(ends.repartitionByRange("depth", "node", "member").withColumn("at", F.spark_partition_id()), "trie-ends")
    parts = dealt.groupBy("depth", "node", "at").agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("part"))
    ordered = parts.withColumnRenamed("node", "conv_id").repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "at")
    out = materialize(ordered.select("depth", "conv_id", "part").mapInArrow(_digests, "depth long, conv_id long, ends_sha256 string"), "trie-digests")
    release(dealt)
    return out


def prefix_trie(conversations: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """One row for each node of the rebuilt conversations' trie."""
    numbers = numbered(conversations)
    turns = rebuilt(numbers, heads, family)
    release(numbers)
    lengths = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("last")), "trie-lengths")
    first, count = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    top = F.lit(first).cast("long")
    live = lengths.where("last > 0").withColumn("above", top)
    levels, start, width = [], 0, 1
    while True:
        end = start + width
        members, nodes = _down(live, turns, start, end)
        nodes.first_level = start + 1
        levels.append((members, nodes, end))
        live = members.where((F.col("pos") == end) & (F.col("n_convs") > 1) & (F.col("last") > end)).select("conv_id", F.col("node").alias("above"), "last")
        if live.isEmpty():
            break
        start, width = end, 1 if end < SINGLY else min(WIDEST, 2 * width)

    done, below = [], None
    for members, nodes, end in reversed(levels):
        below = _up(members, nodes, below, end)
        done.append(below)
    # nodes of chains: below a member that is alone at the end of a stretch
    alone = [m.where((F.col("pos") == end) & (F.col("n_convs") == 1) & (F.col("last") > end)).select("conv_id", "last", F.col("pos").alias("from")) for m, _, end in levels]
    ends = [m.where("pos = last").select(F.col("pos").alias("depth"), "node", F.col("conv_id").alias("member")) for m, _, _ in levels]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    union = lambda frames: frames[0] if len(frames) == 1 else union(frames[: len(frames) // 2]).unionByName(union(frames[len(frames) // 2 :]))
    chains = turns.join(union(alone), "conv_id").where(F.col("pos") > F.col("from")).select(
        F.col("pos").alias("depth"), "conv_id", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("pos") < F.col("last"), one).otherwise(none).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("pos") < F.col("last"), EMPTY).otherwise(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends_sha256"),
    )
    root_ends = lengths.where("last = 0").select(none.alias("depth"), top.alias("node"), F.col("conv_id").alias("member"))
    under = below.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = under.where(F.lit(count > 0)).select(
        none.alias("depth"), top.alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens"),
    )
    digests = ends_digest(union([*ends, root_ends]))
    shared = union([root, *done]).join(digests, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return shared.select(columns).unionByName(chains.select(columns))


# CRC-32 of a conv_id's decimal form, bit by bit; 3988292384 is its polynomial
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)"

ORACLE = f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
head AS (SELECT conv_id, seq, {_CRC} % 6 AS h FROM own),
made AS (SELECT c.conv_id, list_concat(coalesce(b.seq, [])[1:c.h], c.seq[c.h + 1:]) AS seq FROM head c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
walks AS (SELECT conv_id, d, seq[1:d] AS prefix, seq[d].t AS last_text, d = len(seq) AS ends FROM made, unnest(range(0, len(seq) + 1)) AS u(d)),
nodes AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last_text) AS last_text,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM walks GROUP BY d, prefix),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]),
kids AS (SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
known AS (SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN kids k USING (d, conv_id)),
sums AS (SELECT u.a AS d, k.prefix[1:u.a] AS prefix, sum((k.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((k.n_convs - 1) * length(coalesce(k.last_text, '')))::BIGINT AS saved_tokens
         FROM known k, unnest(range(0, k.d + 1)) AS u(a) GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256 FROM known k JOIN sums s ON s.d = k.d AND s.prefix = k.prefix
"""
