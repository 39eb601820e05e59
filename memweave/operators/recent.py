"""The newest distinct items of a key as they stood at each of many moments.

``newest`` answers for every question ``(key, order)`` which items of the key had been
touched last before it. What a question sees depends on the touches before it alone, so
no round for each question is needed:

1. touches and questions are range-partitioned by (key, order), so a hot key spreads over
   partitions;
2. each partition is reduced to the newest items of its keys;
3. the newest before a partition are those of the partitions before, merged in order: a
   stream of a few rows for each key and partition;
4. each partition is read once more, in order, from what came before it.

A task keeps the newest items of one key, whatever the key's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memweave.runtime import materialize, release

_ITEMS = pa.schema([("id", pa.string()), ("uuid", pa.string()), ("content", pa.string()), ("items", pa.list_(pa.struct([("uuid", pa.string()), ("content", pa.string())])))])
_CARRIED = pa.schema([("key", pa.string()), ("part", pa.int32()), ("uuid", pa.string()), ("content", pa.string()), ("stamp", pa.int64())])


class _Newest:
    """Up to ``n`` items by time, of equal times the smaller ids. A touch never moves an item back."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def touch(self, row: dict) -> None:
        held, uuid = self.held, row["uuid"]
        held[uuid] = (max(row["stamp"], held[uuid][0]) if uuid in held else row["stamp"], row["content"])
        if len(held) > self.n:
            del held[max(held, key=self._rank)]

    def _rank(self, uuid: str) -> tuple[int, str]:
        return -self.held[uuid][0], uuid

    def ranked(self) -> list[str]:
        return sorted(self.held, key=self._rank)


def _carried(n: int):
    """From each partition's newest, in order: what each partition of a key starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = (None, None), _Newest(n)
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["key"] != at[0]:
                    now = _Newest(n)
                elif row["part"] != at[1]:
                    out.extend({"key": row["key"], "part": row["part"], "uuid": u, "content": c, "stamp": s} for u, (s, c) in now.held.items())
                at = row["key"], row["part"]
                if row["uuid"] is not None:
                    now.touch(row)
            yield pa.RecordBatch.from_pylist(out, schema=_CARRIED)

    return run


def _answered(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, _Newest(n)
        for b in batches:
            out = []
            for row in b.to_pylist():
                if (row["part"], row["key"]) != at:
                    at, now = (row["part"], row["key"]), _Newest(n)
                if row["id"] is None:
                    now.touch(row)
                else:
                    out.append({"id": row["id"], "uuid": row["uuid"], "content": row["content"], "items": [{"uuid": u, "content": now.held[u][1]} for u in now.ranked()]})
            yield pa.RecordBatch.from_pylist(out, schema=_ITEMS)

    return run


def newest(questions: DataFrame, touches: DataFrame, n: int) -> DataFrame:
    """``(id, uuid, content, items)``: for ``questions (key, order, id, uuid, content)`` the newest ``n`` of ``touches (key, order, uuid, content, stamp)``.

    A question's ``uuid`` and ``content``, where it has them, come back with its answer. Orders are strings; a touch counts for questions of a larger order. An item has one
    content. Items are newest first by ``stamp``, a whole number, then by uuid. Written.
    """
    none = lambda kind: F.lit(None).cast(kind)
    # of one order, questions come first; an order that begins another stands before it
    own = [F.col(c) if c in questions.columns else none("string").alias(c) for c in ("uuid", "content")]
    asked = questions.select("key", F.concat("order", F.lit("\x010")).alias("place"), "id", *own, none("long").alias("stamp"))
    told = touches.select("key", F.concat("order", F.lit("\x011")).alias("place"), none("string").alias("id"), "uuid", "content", F.col("stamp").cast("long").alias("stamp"))
    rows = asked.unionByName(told).repartitionByRange("key", "place", F.coalesce("id", "uuid"))
    rows = materialize(rows.withColumn("part", F.spark_partition_id()), "recent-rows")
    last = rows.where("id IS NULL").groupBy("key", "part", "uuid").agg(F.max("stamp").alias("stamp"), F.first("content").alias("content"))
    rank = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.desc("stamp"), "uuid"))
    tops = last.withColumn("rank", rank).where(F.col("rank") <= n).select("key", "part", "uuid", "content", "stamp")
    # a partition with questions alone starts from something too
    parts = rows.where("id IS NOT NULL").select("key", "part").distinct().select("key", "part", none("string").alias("uuid"), none("string").alias("content"), none("long").alias("stamp"))
    stream = tops.unionByName(parts).repartition("key").sortWithinPartitions("key", "part")
    carried = stream.mapInArrow(_carried(n), "key string, part int, uuid string, content string, stamp long")
    whole = rows.unionByName(carried.select("key", F.lit("").alias("place"), none("string").alias("id"), "uuid", "content", "stamp", "part"))
    ordered = whole.repartition("part", "key").sortWithinPartitions("part", "key", "place").select("part", "key", "id", "uuid", "content", "stamp")
    out = materialize(ordered.mapInArrow(_answered(n), "id string, uuid string, content string, items array<struct<uuid: string, content: string>>"), "recent-items")
    release(rows)
    return out
