import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from memweave import schema
from memweave.functions import ids, scoring
from memweave.operators import corpus, enrich, ingest, listing, providers, render, resolve, search, traverse
from memweave.sources import files
from memweave.sources.changelog import ChangeLog, tombstones, touches
from memweave.streaming import ingest_stream

NODE = "uuid string, node_type string, content string, weight double, user_id string, source string, embedding array<float>, n_obs long"
EDGE = "uuid string, subject_uuid string, predicate string, object_uuid string, weight double, user_id string"


def nodes(spark, *rows):
    full = [(u, {"node_type": "generic", "content": u, "weight": 0.5, "user_id": "global", "source": None, "embedding": [1.0, 0.0], "n_obs": 0} | more) for u, more in rows]
    return spark.createDataFrame([(u, *[m[k] for k in ("node_type", "content", "weight", "user_id", "source", "embedding", "n_obs")]) for u, m in full], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(f"e{k:02}", s, "p", o, w, "global") for k, (s, o, w) in enumerate(rows)], EDGE)


def ids_of(df):
    return sorted(r["uuid"] for r in df.collect())


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "uuid string")


def test_prune(spark):
    n = nodes(spark, ("a", {}), ("b", {"embedding": [0.7, 0.7]}), ("c", {"embedding": [0.0, 1.0]}))
    q = scoring.vector([1.0, 0.0])
    assert ids_of(traverse.prune(n, q, 2)) == ["a", "b"] and ids_of(traverse.prune(n, None, 2)) == ["a", "b"]
    n = nodes(spark, ("sem", {}), ("seen", {"embedding": [0.6, 0.8], "n_obs": 5}))
    assert ids_of(traverse.prune(n, q, 1)) == ["seen"]


def test_expansion_rules(spark):
    n = nodes(spark, ("s", {}), ("a", {}), ("dead", {"weight": 0.0}), ("far", {}), ("l", {"node_type": "log"}), ("x", {}))
    e = edges(spark, ("s", "a", 0.8), ("s", "far", 0.0), ("dead", "s", 0.8), ("a", "l", 0.8), ("l", "x", 0.8), ("s", "gone", 0.8))
    g = traverse.expand(n, e, seeds(spark, "s"), hops=3)
    assert ids_of(g.nodes) == ["a", "far", "l", "s"]  # a dead edge leads on, a log does not
    assert ids_of(g.edges) == ["e00", "e02", "e03", "e05"]  # edges may dangle
    assert ids_of(traverse.expand(n, e, seeds(spark, "none"), hops=2).nodes) == []


def test_one_chance_and_floor(spark):
    me = spark.range(1).select(ids.self_id(F.lit("global"))).first()[0]
    n = nodes(spark, (me, {}), *[(f"k{i}", {"n_obs": i}) for i in range(6)], ("other", {}))
    e = edges(spark, *[(me, f"k{i}", 0.8) for i in range(6)], ("k5", "k0", 0.8))
    assert len(ids_of(traverse.expand(n, e, seeds(spark, me), hops=2, limit_per_hop=1, self_floor=0).nodes)) == 2  # k0 was seen and pruned
    assert len(ids_of(traverse.expand(n, e, seeds(spark, me), hops=1, limit_per_hop=1, self_floor=3).nodes)) == 4


def test_source_filter(spark):
    n = nodes(spark, ("s", {}), ("a", {"source": "A"}), ("b", {"source": "B"}), ("t", {"source": "B"}), ("u", {}))
    e = edges(spark, ("s", "a", 0.8), ("s", "b", 0.8), ("t", "u", 0.8))
    assert ids_of(traverse.expand(n, e, seeds(spark, "s"), hops=1, source="A").nodes) == ["a", "s"]
    assert ids_of(traverse.expand(n, e, seeds(spark, "t"), hops=1, source="A").nodes) == ["t"]  # a seed stays, but is not expanded


def test_neighbour_cap(spark):
    e = edges(spark, *[("s", f"n{i:03}", 0.8) for i in range(70)])
    assert traverse.incident_edges(e, seeds(spark, "s"), "global").count() == 50
    assert traverse.incident_edges(e, seeds(spark, "s"), "someone").count() == 0


def test_search(spark):
    n = nodes(spark, ("old", {"node_type": "log", "embedding": [0.8, 0.6]}), ("new", {"node_type": "log", "embedding": [0.8, 0.6]}), ("dead", {"weight": 0.0}), ("p", {"weight": 0.3, "n_obs": 10}), ("none", {"embedding": None}))
    n = n.withColumn("updated_at", F.when(F.col("uuid") == "old", F.lit("2024-12-02")).otherwise(F.lit("2024-12-31")).cast("timestamp"))
    q = scoring.vector([1.0, 0.0])
    got = [r.uuid for r in search.search_nodes(n, q, "2025-01-01", node_types=["log"]).collect()]
    assert got == ["new", "old"]
    assert ids_of(search.search_nodes(n, q, "2025-01-01")) == ["p"]
    assert ids_of(search.search_nodes(n, q, "2025-01-01", min_significance=0.4)) == []


def test_defaults_on_read(spark):
    raw = spark.createDataFrame([("a", None, 0.7, "2024-01-01T00:00:00Z", 1.0), ("b", "x", None, "junk", 2.0)], "uuid string, content string, significance_weight double, created_at string, vector_distance double")
    a, b = schema.as_nodes(raw).orderBy("uuid").collect()
    assert (a.node_type, a.content, a.weight, a.metadata, a.journal_entry_ids, a.user_id) == ("generic", "", 0.7, "{}", [], "global") and a.created_at is not None
    assert b.weight == 0.5 and b.created_at is None and "vector_distance" not in b
    assert "source" not in json.loads(schema.as_json(schema.as_nodes(raw)).first().json)
    e = schema.as_edges(spark.createDataFrame([("r", "s", None)], "uuid string, subject_uuid string, object_uuid string"))
    assert e.first().weight == 0.8 and schema.broken_edges(e).count() == 1


def test_listing(spark):
    n = nodes(spark, *[(f"n{i}", {"node_type": "log" if i % 2 else "generic"}) for i in range(6)]).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("embedding", F.lit(None).cast("array<float>"))
    assert [r.uuid for r in listing.list_nodes(n, limit=2, offset=1).collect()] == ["n1", "n2"]
    assert ids_of(listing.list_entries(n, limit=2)) == ["n1", "n3"] and listing.list_entries(n, since="2025-01-01").count() == 0
    assert listing.entry_by_uuid(n, "n0").count() == 0 and listing.entry_by_uuid(n, "n1").count() == 1
    assert listing.to_embed(n, 2).count() == 2
    for bad in (0, 501):
        with pytest.raises(ValueError):
            listing.list_nodes(n, limit=bad)


def test_source_logs(spark):
    logs = nodes(spark, *[(f"log-{i}", {"node_type": "log", "content": "x" * 300}) for i in range(1, 6)])
    ents = spark.createDataFrame([("e", "person", [f"log-{i}" for i in range(1, 6)]), ("one", "person", ["log-1"]), ("l", "log", ["log-2"])], "uuid string, node_type string, journal_entry_ids array<string>")
    got = sorted((r.entity_uuid, r.pos, r.log_uuid, len(r.snippet)) for r in enrich.source_logs(ents, logs).collect())
    assert got == [("e", 1, "log-4", 250), ("e", 2, "log-5", 250), ("one", 1, "log-1", 250)]


def test_greedy_resolution_uses_earlier_mentions(spark):
    rows = [(1, 1, "Ada", "person", [1.0, 0.0]), (2, 2, "Ada L", "person", [0.99, 0.1]), (3, 3, "Bob", "person", [0.0, 1.0]), (4, 4, "Ada", "tool", [1.0, 0.0]), (5, 5, " ada ", "person", [1.0, 0.0])]
    got = {r.mention_id: r.uuid for r in resolve.greedy_resolution(spark.createDataFrame(rows, "mention_id long, pos long, name string, node_type string, embedding array<double>")).collect()}
    assert got[1] == got[2] == got[5] and len({got[1], got[3], got[4]}) == 3


def test_merge_keeps_doubles_of_the_base(spark):
    n = nodes(spark, ("a", {}), ("b", {}))
    base = traverse.Subgraph(n, edges(spark, ("a", "b", 0.8), ("a", "b", 0.8)))
    extra = traverse.Subgraph(nodes(spark, ("b", {"content": "new"})), edges(spark, ("a", "b", 0.1), ("b", "a", 0.1)).withColumn("uuid", F.concat(F.lit("x"), "uuid")))
    m = traverse.merge(base, extra)
    assert {r.uuid: r.content for r in m.nodes.collect()} == {"a": "a", "b": "new"} and ids_of(m.edges) == ["e00", "e01", "xe01"]


def test_markdown_and_dot(spark):
    n = nodes(spark, ("seed-node-1", {"node_type": "person", "content": "Ada"}), ("c", {"node_type": "chunk", "content": "t" * 900}), ("l", {"node_type": "log"})).withColumn("metadata", F.lit('{"filename": "f.md", "chunk_index": 2}'))
    g = traverse.Subgraph(n, edges(spark, ("seed-node-1", "missing-node", 0.8)))
    logs = spark.createDataFrame([("seed-node-1", 1, "said so")], "entity_uuid string, pos int, snippet string")
    lines = [r.line for r in render.markdown(g, seeds(spark, "seed-node-1"), logs).orderBy("pos").collect()]
    assert lines[0] == "## Knowledge Graph" and lines[1].startswith("- **person** `seed-nod` [SEED]: Ada") and lines[2] == '  [source] "said so"'
    assert "- Ada --[p]--> missing-" in lines and lines[-2] == "## Source Chunks" and lines[-1] == '[f.md chunk 2] "' + "t" * 800 + '"'
    dot = [r.line for r in render.dot(g).orderBy("pos").collect()]
    assert dot[0] == "digraph memory {" and dot[-1] == "}" and not any('"l"' in x for x in dot)


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log")
    log.append(spark.createDataFrame([(1, "a", "create", "first", 0.8, ["j1"]), (2, "b", "touch", "x", None, ["j1"])], "seq long, uuid string, op string, content string, weight double, journal_entry_ids array<string>"))
    log.append(tombstones(3, seeds(spark, "a", "zz"), log.state()))
    log.append(touches(4, seeds(spark, "a"), F.lit("j2"), F.lit("2024-01-01").cast("timestamp")))
    log.append(touches(5, seeds(spark, "a"), F.lit("j1"), F.lit("2024-01-02").cast("timestamp")))
    (a,) = log.state().collect()
    assert (a.uuid, a.content, a.weight, a.journal_entry_ids) == ("a", "first", 0.0, ["j1", "j2"])
    small = log.compact(f"{tmp_path}/compact")
    assert small.state().select("uuid", "content", "weight", "journal_entry_ids").collect() == log.state().select("uuid", "content", "weight", "journal_entry_ids").collect()
    assert log.wipe(f"{tmp_path}/empty").log().count() == 0 and log.log().count() == 5


def test_files_and_requests(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("one\n\ntwo")
    (tmp_path / "in/d/b.py").write_text("import os")
    (tmp_path / "in/empty.txt").write_text("")
    got = sorted((r.filename, r.content) for r in files.documents(spark, f"{tmp_path}/in", "c", f"{tmp_path}/in").collect())
    assert got == [("a.txt", "one\n\ntwo"), ("d/b.py", "import os")]
    assert files.dump(spark, f"{tmp_path}/in", "*.py").first().text == "==> d/b.py <==\nimport os"
    assert files.command(spark, ["met", "Ada"]).first().text == "met Ada"
    for bad in ({"query": "q" * 501}, {"text": ""}, {"limit": 0}, {"offset": -1}, {"documents": []}):
        with pytest.raises(ValueError):
            files.Request(**bad)


def test_bulk_requests(spark, tmp_path):
    lines = [{"seed_ids": ["a"]}, {"query": "x"}, {"seed_ids": [], "query": "q" * 501, "hops": 1}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken")
    got = [(r.hops, r.user_id, list(r.errors)) for r in files.requests(spark, f"{tmp_path}/r.json", "expand").collect()]
    assert got == [(2, "global", []), (2, "global", ["seed_ids is missing"]), (1, "global", ["query has over 500 characters"]), (2, "global", ["no JSON of this kind", "seed_ids is missing"])]
    docs = [{"documents": []}, {"documents": [{"text": "", "filename": "a"}]}, {"documents": [{"text": "t", "filename": "a"}], "chunk_size": 5}]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, docs)))
    assert [(r.chunk_size, list(r.errors)) for r in files.requests(spark, f"{tmp_path}/c.json", "corpus").collect()] == [(600, ["no documents"]), (600, ["a document lacks its text or filename"]), (5, [])]


def test_status_keeps_failures(spark):
    n = spark.createDataFrame([("a", "2024-02-01", None), ("b", "2024-02-01", "err"), ("c", None, None)], "uuid string, pipeline_done_at string, pipeline_error string")
    r = corpus.status(seeds(spark, "a", "b", "b", "c", "zz"), n).first()
    assert (r.total, r.completed, r.failed, r.is_complete) == (4, 1, 1, False)
    r = corpus.status(seeds(spark, "a", "b"), n).first()
    assert r.is_complete


def test_retry():
    calls = []

    def make():
        def run(texts):
            calls.append(1)
            if len(calls) < 2:
                raise TimeoutError
            return texts
        return run

    assert providers.with_retry(make)()(["x"]) == ["x"] and len(calls) == 2
    calls.clear()
    with pytest.raises(TimeoutError):
        providers.with_retry(make, 1)()(["x"])


def test_stream_of_entries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    nodes_, edges_ = ChangeLog(spark, f"{tmp_path}/nodes"), ChangeLog(spark, f"{tmp_path}/edges")
    nodes_.append(spark.createDataFrame([(-1, "seed", "create", "Seed", "tool")], "seq long, uuid string, op string, content string, node_type string"))
    row = {"entry_id": "1", "text": "Ada works at Lab. Bob knows Ada.", "user_id": "u", "at": "2024-01-01T00:00:00Z"}
    (tmp_path / "in/1.json").write_text(json.dumps(row))
    for turn in range(2):
        ingest_stream.start(spark, f"{tmp_path}/in", nodes_, edges_, f"{tmp_path}/cp", schema.PREDICATES).awaitTermination(120)
        (tmp_path / "in/2.json").write_text(json.dumps(row | {"entry_id": "2", "text": "Bob knows Ada."}))
    got = {r.content: len(r.journal_entry_ids) for r in edges_.state().collect()}
    assert got == {"Ada works_at Lab": 1, "Bob knows Ada": 2}
    assert sorted(r.content for r in nodes_.state().where("node_type = 'generic'").collect()) == ["Ada", "Bob", "Lab"]
    assert nodes_.state().where("node_type = 'log'").count() == 2


def test_corpus_ingest(spark):
    from memweave.functions.ids import content_hash, document_id

    docs = spark.createDataFrame([("c", "a.md", "one two\n\nthree"), ("c", "b.py", "import os\n\ndef f():\n    pass\n"), ("c", "same.md", "still")], "corpus_id string, filename string, content string")
    stored = docs.select(document_id(F.col("corpus_id"), F.col("filename")).alias("uuid"), F.when(F.col("filename") == "same.md", content_hash(F.col("content"))).otherwise("old").alias("content_hash")).where("uuid <> ''")
    stored = stored.join(docs.where("filename <> 'b.py'").select(document_id(F.col("corpus_id"), F.col("filename")).alias("uuid")), "uuid", "left_semi")
    a = stored.where("content_hash = 'old'").first().uuid
    old = spark.createDataFrame([("old-chunk", "chunk", a, "global", 0.4), ("dead", "chunk", a, "global", 0.0)], "uuid string, node_type string, document_id string, user_id string, weight double").withColumn("content", F.lit("x"))
    got = corpus.ingest_corpus(docs, stored, old, words=2)
    assert {r.filename: r.status for r in got.status.collect()} == {"a.md": "changed", "b.py": "new", "same.md": "unchanged"}
    assert sorted(r.node_type for r in got.nodes.collect()) == ["chunk"] * 4 + ["corpus", "document", "document", "function", "log", "log", "module", "module"]
    kinds = sorted(r.predicate for r in got.edges.collect())
    assert kinds == ["contains", "defines", *["has_chunk"] * 4, "has_summary", "has_summary", "imports", "next_chunk", "next_chunk"]
    assert ids_of(got.dead) == ["old-chunk"]


def test_corpus_ingest_isolates_failures(spark):
    docs = spark.createDataFrame([("c", "good.md", "Ada works at Lab. Ada rests."), ("c", "bad.md", "boom"), ("c", "late.md", "Bob knows Ada. crash")], "corpus_id string, filename string, content string")
    none = nodes(spark, ("other", {})).withColumn("document_id", F.lit(None).cast("string"))

    def make():
        inner = providers.rules()

        def run(requests):
            for r in requests:
                if "boom" in r.user or "crash" in r.user and not r.user.startswith("Document: "):
                    raise RuntimeError("no answer")
            return inner(requests)

        return run

    got = corpus.ingest_corpus(docs, spark.createDataFrame([], "uuid string, content_hash string"), none, make=make, at="2024-01-01T00:00:00+00:00")
    name = {r.uuid: r.filename for r in got.status.collect()}
    assert {name[r.uuid] for r in got.failed.collect()} == {"bad.md", "late.md"}
    assert {name[r.uuid]: r.pipeline_error for r in got.marks.collect()} == {"good.md": None, "bad.md": "RuntimeError: no answer", "late.md": "RuntimeError: no answer"}
    found = sorted((r.predicate, name.get(r.subject_uuid) or name.get(r.object_uuid) or "") for r in got.edges.collect())
    assert found == [("contains", "bad.md"), ("contains", "good.md"), ("contains", "late.md"), ("has_chunk", "good.md"), ("has_summary", "good.md"), ("mentioned_in", ""), ("mentioned_in", ""), ("works_at", "")]
    assert sorted(r.content for r in got.nodes.where("node_type = 'generic'").collect()) == ["Ada", "Lab"]


def test_ingest_matches_earlier_new_names(spark):
    """Two new names that are near are one node; a stored one is found by vector, a generated id is taken as it is."""
    entries = spark.createDataFrame([("1", "t", "u", None, None, "Ada Byron"), ("2", "t", "u", None, None, "Ada B"), ("3", "t", "u", None, None, "Old")], "entry_id string, text string, user_id string, domain string, source string, name string")
    entries = entries.withColumn("at", F.lit("2024-01-01").cast("timestamp")).withColumn("answer", F.concat(F.lit("status: ok\ntriples:\n"), F.col("name"), F.lit(" | knows | SELF")))
    stored = spark.createDataFrame([("old", "generic", "Old Man", "old man", [0.0, 1.0])], "uuid string, node_type string, content string, name_key string, embedding array<double>")
    vector = lambda c: F.when(c.startswith("Ada"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    done = ingest.ingest(entries, stored, schema.PREDICATES, answers={"extract": "answer", "collide": F.lit("UPDATE")}, embed=vector, collisions=True)
    got = {r.entry_id: (r.uuid, r.content) for r in done.named.where("content <> 'Me'").collect()}
    assert got["1"][0] == got["2"][0] != "old" and got["3"] == ("old", "Old Man")
    assert [(r.uuid, r.content) for r in done.renamed.collect()] == [("old", "Old")]
    rows = {r.uuid: (r.op, r.content) for r in ingest.changes(1, done.nodes, ["uuid", "content", "weight"]).collect()}
    assert rows["old"] == ("touch", None) and rows[got["1"][0]][0] == "create"


def test_nearest_by_cells_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(resolve, "BLOCK", 20)
    v = rng.normal(size=(300, 3))
    v[7] = 0
    n = spark.createDataFrame([(f"n{k:03}", "ab"[k % 2], [float(x) for x in v[k]]) for k in range(200)], "uuid string, node_type string, embedding array<double>")
    m = spark.createDataFrame([(k, "ab"[k % 2], [float(x) for x in v[k]]) for k in [7, *range(190, 300)]], "mention_id long, node_type string, embedding array<double>")
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    for threshold in (0.0, 0.02, 0.3, 1.2):
        want = {}
        for k in [7, *range(190, 300)]:
            d, u = min((round(1 - float(unit[k] @ unit[j]), 6) + 0.0, f"n{j:03}") for j in range(200) if j % 2 == k % 2)
            if d <= threshold:
                want[k] = (u, d)
        assert {r.mention_id: (r.near_uuid, r.distance) for r in resolve.nearest(m, n, threshold).collect()} == want


def test_vocabulary(spark, tmp_path):
    from memweave.sources.vocabulary import Vocabulary

    v = Vocabulary(spark, f"{tmp_path}/v")
    assert {r.name for r in v.names("predicate").collect()} == set(schema.PREDICATES)
    v.append(spark.createDataFrame([("met",), ("met",), ("knows",)], "name string"))
    v.append(spark.createDataFrame([("met",)], "name string"))
    assert sorted(r.name for r in v.names("predicate").collect()) == sorted([*schema.PREDICATES, "met"]) and v.names("node_type").count() == len(schema.NODE_TYPES)


def test_scheduled_consolidation(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    nodes_, edges_ = ChangeLog(spark, f"{tmp_path}/nodes"), ChangeLog(spark, f"{tmp_path}/edges")
    nodes_.append(spark.createDataFrame([(1, "log_1", "create", "tea again", "log", "u", "general"), (1, "log_2", "create", "no", "log", "w", "general")], "seq long, uuid string, op string, content string, node_type string, user_id string, domain string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    (tmp_path / "runs/1.json").write_text(json.dumps({"user_id": "u", "at": "2024-02-01T00:00:00Z"}))

    def make():
        return lambda requests: ["Ann drinks Tea" if r.user.startswith("Notes") else "status: ok\ntriples:\nAnn | owns | Tea" for r in requests]

    ingest_stream.start_consolidation(spark, f"{tmp_path}/runs", nodes_, edges_, f"{tmp_path}/cp", schema.PREDICATES, make).awaitTermination(120)
    state = nodes_.state()
    assert [(r.content, r.domain, r.user_id) for r in state.where("node_type = 'log' AND uuid NOT IN ('log_1', 'log_2')").collect()] == [("Ann drinks Tea", "core_memory", "u")]
    assert sorted(r.content for r in state.where("node_type = 'generic'").collect()) == ["Ann", "Tea"] and edges_.state().count() == 1


def test_summary(spark):
    from memweave.operators import summarize

    embed = providers.hashed_words(16)
    rows = [("ada", "Ada builds engines"), ("lab", "Lab of engines"), ("bob", "Bob likes rare tea")]
    n = nodes(spark, *[(u, {"content": t, "embedding": embed([t])[0]}) for u, t in rows])
    e = edges(spark, ("ada", "lab", 0.8))
    calls = []

    def ask(requests):
        calls.append(requests[0])
        return [["a draft"], ["- rare tea"], ["short"], ["A long answer. " * 10]][len(calls) - 1]

    got = summarize.summarize(n, e, seeds(spark, "ada"), "who builds engines here", "2024-01-01", ask, embed)
    assert got.queries == ["rare tea"] and len(calls) == 4 and "a draft" in calls[2].user and got.debug["pass2"]["performed"] and got.answer.startswith("A long answer")
    assert "Bob likes rare tea" in got.markdown and "[SEED]: Ada builds engines" in got.markdown


def test_greedy_resolution_by_blocks_equals_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(25, 4))
    rows = [(k, int(k * 37 % 101), f"name {k % 90}", "asset" if k % 4 else "place", [float(x) for x in base[k % 25] + (k % 3) * 0.3 * rng.normal(size=4)]) for k in range(101)]
    rows += [(200 + k, 200 + k, f"zero {k}", "asset", [0.0] * 4) for k in range(3)]
    monkeypatch.setattr(resolve, "BLOCK", 7)
    # the old code held a type in one task, whatever its size
    df = spark.createDataFrame(rows, "mention_id long, pos long, name string, node_type string, embedding array<double>")
    for threshold in (0.15, 0.5):
        got = {r.mention_id: r.uuid for r in resolve.greedy_resolution(df, threshold).collect()}
        leaders, want, by_name = {}, {}, {}
        for m, _, name, kind, v in sorted(rows, key=lambda r: r[1]):
            if (kind, name) not in by_name:
                v = np.array(v) / (np.linalg.norm(v) or 1)
                known = leaders.setdefault(kind, [])
                near = min(((round(1 - float(u @ v), 6), n) for n, (u, _) in enumerate(known)), default=(9, 0))
                own = hashlib.sha1(f"{kind}:{name}".encode()).hexdigest()
                if near[0] > threshold:
                    known.append((v, "entity_" + own))
                    near = (0, len(known) - 1)
                by_name[kind, name] = known[near[1]][1]
            want[m] = by_name[kind, name]
        assert got == want and 4 < len(set(want.values())) < len(rows) - 20


def test_vectors_without_clusters_meet_in_blocks_and_planes_find_nearly_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(resolve, "BLOCK", 100)
    v = rng.normal(size=(1500, 24))
    near = v[:300] + 0.22 * rng.normal(size=(300, 24))
    n = spark.createDataFrame([(f"n{k:04}", "a", [float(x) for x in v[k]]) for k in range(1500)], "uuid string, node_type string, embedding array<double>")
    m = spark.createDataFrame([(k, "a", [float(x) for x in near[k]]) for k in range(300)], "mention_id long, node_type string, embedding array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit(near) @ unit(v).T, 6)
    want = {k: (f"n{d[k].argmin():04}", d[k].min()) for k in range(300) if d[k].min() <= 0.15}
    exact = {r.mention_id: (r.near_uuid, r.distance) for r in resolve.nearest(m, n).collect()}
    assert exact == want and len(want) > 200
    some = {r.mention_id: (r.near_uuid, r.distance) for r in resolve.nearest(m, n, exact=False).collect()}
    assert all(want[k] == x for k, x in some.items()) and len(some) >= 0.9 * len(want)


def test_greedy_resolution_of_vectors_of_two_lengths(spark):
    rows = [(k, k, f"name {k}", "a", v) for k, v in enumerate([[1.0, 0.0], [1.0], [0.0, 1.0, 0.0], [0.0, 1.0]])]
    got = resolve.greedy_resolution(spark.createDataFrame(rows, "mention_id long, pos long, name string, node_type string, embedding array<double>"))
    to = {r.mention_id: r.uuid for r in got.collect()}
    assert to[0] == to[1] != to[2] == to[3]


def test_bulk_requests_equal_single_ones(spark):
    """Requests with tenants, types, limits and sources give what each gives alone; a request without a vector finds nothing."""
    from memweave.operators import bulk, search, traverse

    rng = np.random.default_rng(8)
    vec = lambda: [float(x) for x in rng.normal(size=4)]
    kinds = ["person", "log", "asset", None]
    n = spark.createDataFrame(
        [(f"n{k:03}", kinds[k % 4], "ab"[k % 2], "x" if k % 3 else None, 0.0 if k % 11 == 0 else 0.5, vec() if k % 7 else None, k % 5, "d" if k % 2 else "e") for k in range(200)],
        "uuid string, node_type string, user_id string, source string, weight double, embedding array<double>, n_obs int, domain string",
    )
    e = spark.createDataFrame([(f"e{k:04}", f"n{rng.integers(200):03}", f"n{rng.integers(200):03}", "ab"[k % 2], 0.0 if k % 9 == 0 else 0.8) for k in range(900)], "uuid string, subject_uuid string, object_uuid string, user_id string, weight double")
    asked = [(k, "ab"[k % 2], vec() if k != 3 else None, None if k % 3 else "d", [None, ["person"], ["log", "asset"]][k % 3], 1 + k, 0.0, "x" if k % 2 else None) for k in range(5)]
    q = spark.createDataFrame(asked, "request_id long, user_id string, embedding array<double>, domain string, node_types array<string>, limit int, min_significance double, source string")
    got = bulk.search_requests(q, n, "2024-01-01").collect()
    seeds = [(k, f"n{5 * k + j:03}") for k in range(5) for j in range(3)]
    walk = bulk.expand_requests(q, spark.createDataFrame(seeds, "request_id long, uuid string"), n, e, limit_per_hop=4, self_floor=2, cap=3)
    walked = {kind: [tuple(r) for r in getattr(walk, kind).collect()] for kind in ("nodes", "edges")}
    for k, user, v, domain, types, limit, least, source in asked[2:]:
        query = None if v is None else F.array(*map(F.lit, v))
        if v is not None:
            alone = search.search_nodes(n, query, "2024-01-01", user, domain, types, limit, least).collect()
            assert [(r.uuid, r.effective) for r in sorted((r for r in got if r.request_id == k), key=lambda r: r.place)] == [(r.uuid, r.effective) for r in alone]
        else:
            assert not [r for r in got if r.request_id == k]
        monkey = traverse.NEIGHBOR_EDGES
        assert monkey == 50
        one = traverse.expand(n, e, spark.createDataFrame([(u,) for i, u in seeds if i == k], "uuid string"), query, 2, 4, user, 2, source)
        full = bulk.expand_requests(q.where(F.col("request_id") == k), spark.createDataFrame(seeds, "request_id long, uuid string"), n, e, limit_per_hop=4, self_floor=2)
        for kind in ("nodes", "edges"):
            assert sorted(r.uuid for r in getattr(full, kind).collect()) == sorted(r.uuid for r in getattr(one, kind).collect())
    assert {r[0] for r in walked["nodes"]} == set(range(5)) and len(walked["edges"]) == len(set(walked["edges"]))


def test_equal_vectors_are_met_once(spark, monkeypatch):
    """Searches and matches over 900 rows of three vectors: what meets is one row for each vector and scope."""
    from memweave.operators import bulk, resolve, search

    vectors = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]
    nodes = [(f"u{k:04d}", "t", "general", "log" if k % 5 == 0 else "asset", 0.5, k % 4, vectors[k % 3]) for k in range(900)]
    n = spark.createDataFrame(nodes, "uuid string, user_id string, domain string, node_type string, weight double, n_obs long, embedding array<float>")
    asked = [(k, "t", [1.0, 0.1 * k], None, ["log"] if k % 2 else None, 1 + 12 * k, 0.0) for k in range(5)]
    q = spark.createDataFrame(asked, "request_id long, user_id string, embedding array<float>, domain string, node_types array<string>, `limit` int, min_significance double")
    sizes = {}
    for module in (bulk, resolve):
        real = module.materialize

        def spy(df, label, real=real):
            out = real(df, label)
            sizes[label] = out.count()
            return out

        monkeypatch.setattr(module, "materialize", spy)
    got = {}
    for r in bulk.search_requests(q, n, "2024-01-01").collect():
        got.setdefault(r.request_id, {})[r.place] = (r.uuid, r.effective)
    for k, user, v, _, types, limit, _ in asked:
        want = search.search_nodes(n, bulk.scoring.vector(v), "2024-01-01", user, node_types=types, limit=limit).orderBy("effective", "uuid").collect()
        assert [got[k][p + 1] for p in range(len(want))] == [(r.uuid, r.effective) for r in want] and len(want) == len(got[k])
    assert sizes["bulk-classes"] == 6
    m = spark.createDataFrame([(k, "asset", vectors[k % 2]) for k in range(300)], "mention_id long, node_type string, embedding array<float>")
    near = {r.mention_id: (r.near_uuid, r.distance) for r in resolve.nearest(m, n).collect()}
    assert near == {k: (min(u for u, _, _, t, _, _, v in nodes if t == "asset" and v == vectors[k % 2]), 0.0) for k in range(300)}
    assert sizes["node-vectors"] == 6 and sizes["mention-vectors"] == 2
