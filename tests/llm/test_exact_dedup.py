import hashlib
from collections import defaultdict

from memweave.llm.exact_dedup import DigestIndex, exact_dedup

SCHEMA = "doc_id long, text string, keep_id string"
ROWS = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", None), (5, "A", "x"), (6, "b" * 100_000, "x"), (2, "a", "y"), (None, "a", "n"), (None, "only", "n")]


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_second_batch_meets_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    exact_dedup(spark.createDataFrame([(1, "a", ""), (2, "b", "")], SCHEMA), index)
    got = exact_dedup(spark.createDataFrame([(9, "a", ""), (8, "c", "")], SCHEMA), index)
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(9, 1, False), (8, 8, True)}
    assert index.rows().count() == 3


def test_anti_join_reads_the_buckets_of_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_an_index_has_a_name_and_grows(spark, monkeypatch):
    from memweave.llm import exact_dedup as e

    monkeypatch.setattr(e, "BUCKET_ROWS", 10)
    assert [e.buckets_for(n) for n in (0, 160, 161, 1000)] == [16, 16, 32, 128]
    first = [(k, f"t{k}", "") for k in range(300)]
    one = DigestIndex(spark, "told_before")
    exact_dedup(spark.createDataFrame(first, SCHEMA), one)
    one.forget()  # as a session's end does
    again = DigestIndex(spark, "told_before")
    assert again.buckets == 32 and again.rows().count() == 300
    got = exact_dedup(spark.createDataFrame([(900 + k, f"t{k}", "") for k in range(200, 800)], SCHEMA), again).collect()
    assert again.buckets == 128 and again.rows().count() == 800
    assert sorted(r.doc_id for r in got if r.kept) == list(range(1200, 1700)) and {r.keep_id for r in got if not r.kept} == set(range(200, 300))
    again.forget()
    before = len(spark.catalog.listTables())
    exact_dedup(spark.createDataFrame(first, SCHEMA)).count()
    assert len(spark.catalog.listTables()) == before


def test_an_index_stands_in_its_folder(spark, tmp_path, monkeypatch):
    """What a session's catalog knows does not matter; a layout without its manifest row is not there; the nameless leave nothing."""
    from memweave import runtime
    from memweave.llm import exact_dedup as e

    path = f"{tmp_path}/index"
    one = DigestIndex(spark, path=path)
    exact_dedup(spark.createDataFrame([(k, f"t{k}", "") for k in range(100)], SCHEMA), one)
    one.forget()
    (tmp_path / "index/files-of-a-dead-writer").mkdir()
    monkeypatch.setattr(e, "BUCKET_ROWS", 10)
    other = DigestIndex(spark, path=path)
    got = exact_dedup(spark.createDataFrame([(500 + k, f"t{k}", "") for k in range(50, 400)], SCHEMA), other).collect()
    assert sum(not r.kept for r in got) == 50 and other.buckets > 16
    other.forget()
    assert DigestIndex(spark, path=path).rows().count() == 400 and DigestIndex(spark, path=path).buckets == other.buckets
    before = set(runtime._written(spark))
    exact_dedup(spark.createDataFrame([(1, "a", "")], SCHEMA)).collect()
    (left,) = set(runtime._written(spark)) - before
    runtime._delete(spark, left)
    assert not __import__("os").path.exists(left.removeprefix("file:")) and left not in runtime._written(spark)
