"""State that lasts over batches: order, times, keyed reads, compaction, streams."""

import hashlib
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memweave import schema
from memweave.operators import ingest, recent
from memweave.sources.changelog import ChangeLog, Sequence, fold
from memweave.sources.keyed import KeyedLog
from memweave.streaming import ingest_stream

ENTRY = "entry_id string, text string, user_id string, domain string, source string, at timestamp, answer string"


def entry(spark, rows):
    made = [(i, "t", u, None, None, at, "status: ok\ntriples:\n" + "\n".join(told)) for i, u, at, *told in rows]
    return spark.createDataFrame(made, ENTRY.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))


def newest_brute(questions, touches, n):
    out = {}
    for key, order, i in questions:
        held = {}
        for k, o, uuid, content, stamp in sorted(touches, key=lambda t: t[1]):
            if k == key and o < order:
                held[uuid] = (max(stamp, held[uuid][0]) if uuid in held else stamp, content)
        out[i] = [(u, held[u][1]) for u in sorted(held, key=lambda u: (-held[u][0], u))[:n]]
    return out


def test_newest_as_of_against_brute_force(spark):
    rng = random.Random(4)
    touches, questions = [], []
    for k in range(400):
        key = "hot" if k % 2 else f"k{rng.randrange(5)}"
        u = rng.randrange(30)
        touches.append((key, f"{k:05}", f"u{u}", f"c{u}", k // 3))
        questions.append((rng.choice(["hot", "k1", "none"]), f"{rng.randrange(400):05}", f"q{k}"))
    touches += [("hot", "", f"old{k}", "o", -5) for k in range(20)]
    got = recent.newest(spark.createDataFrame(questions, "key string, order string, id string"), spark.createDataFrame(touches, "key string, order string, uuid string, content string, stamp long").repartition(3), 5)
    assert {r.id: [(x.uuid, x.content) for x in r["items"]] for r in got.collect()} == newest_brute(questions, touches, 5)


def test_a_batch_is_its_entries_one_by_one(spark, tmp_path):
    """Supersession, times and predicates of one batch equal those of a batch for each entry."""
    rows = [
        ("1", "u", "2024-01-01", "SELF | deadline_is | monday"),
        ("2", "u", "2024-01-02", "SELF | deadline_is | tuesday", "Ada | NEW: enjoys | tea"),
        ("3", "v", "2024-01-02", "SELF | deadline_is | monday"),
        ("4", "u", "2024-01-03", "Ada | NEW: likes | tea", "SELF | deadline_is | monday"),
        ("5", "u", "2024-01-04", "SELF | deadline_is | friday", "Bob | NEW: likes | tea"),
    ]
    answers = {
        "extract": "answer", "supersede": F.expr("facts[0].uuid"),
        "gate": F.expr("CASE WHEN array_contains(split(known_names, ', '), 'enjoys') THEN 'EXISTING: enjoys' ELSE 'NEW' END"),
    }

    def run(batches, name):
        nodes, edges = KeyedLog(spark, f"{tmp_path}/{name}-n", buckets=4, names=True), KeyedLog(spark, f"{tmp_path}/{name}-e", key="subject_uuid", buckets=4)
        known = list(schema.PREDICATES)
        for k, batch in enumerate(batches):
            done = ingest.ingest(entry(spark, batch), nodes, known, answers=answers, edges=edges)
            known += [r["name"] for r in done.predicates.collect()]
            ingest_stream.write(done, k, nodes, edges, done.stored_edges, None)
        seen = edges.journal().groupBy("uuid").count()
        state = edges.state().join(seen, "uuid").select("content", "weight", "created_at", "updated_at", "count").collect()
        return sorted(map(tuple, state)), sorted(map(tuple, nodes.state().select("uuid", "content", "updated_at").collect())), known

    whole, single = run([rows], "a"), run([[r] for r in rows], "b")
    assert whole == single
    told = {content: weight for content, weight, *_ in whole[0]}
    assert told["Ada enjoys tea"] == 0.8 and "Ada likes tea" not in told and "enjoys" in whole[2] and "likes" not in whole[2]
    assert sum(w == 0 for _, w, *_ in whole[0]) == 2 and told["Me deadline_is friday"] == 0.8


def test_keyed_state_reads_by_key_and_equals_the_full_fold(spark, tmp_path, monkeypatch):
    from memweave.sources import keyed

    log = KeyedLog(spark, f"{tmp_path}/log", buckets=32, names=True)
    rng = random.Random(2)
    rows = [(k, f"n{rng.randrange(300)}", "create" if k < 300 or k > 1200 else "touch", f"c{k}", f"name {rng.randrange(40)}", [f"j{k}"], f"kind {k % 3}") for k in range(1500)]
    df = spark.createDataFrame(rows, "seq long, uuid string, op string, content string, name_key string, journal_entry_ids array<string>, node_type string")
    for part in range(3):
        log.append(df.where(F.floor(F.col("seq") / 500) == part))
        if part == 1:
            log.compact()
    want = {r.uuid: (r.content, r.journal_entry_ids) for r in fold(df).collect()}
    assert {r.uuid: r.content for r in log.state().collect()} == {u: c for u, (c, _) in want.items()}
    said = {}
    for r in sorted(log.journal().collect(), key=lambda r: (r.seq, r.pos)):
        said.setdefault(r.uuid, []).append(r.log_id)
    assert {u: j for u, j in said.items() if u in want} == {u: j for u, (_, j) in want.items()}
    last = {}
    for r in sorted(log.last_entries().collect(), key=lambda r: r.place):
        last.setdefault(r.uuid, []).append(r.log_id)
    assert {u: j for u, j in last.items() if u in want} == {u: j[-2:] for u, (_, j) in want.items()}
    counts = lambda: {r["value"]: r["n"] for r in log.counts("node_type").collect()}
    full = {r.node_type: r["count"] for r in log.state().groupBy("node_type").count().collect()}
    assert counts() == full and sum(full.values()) == len(want)
    one = min(want)
    keys = spark.createDataFrame([(one,), ("name 3",), ("absent",)], "key string")
    picked = {r.uuid: r.name_key for r in log.pick(keys).collect()}
    state = {r.uuid: r.name_key for r in log.state().collect()}
    # those that had the name before may come along
    assert len(picked) < len(state) / 3 and set(picked) >= {one} | {u for u, name in state.items() if name == "name 3"} and all(state[u] == n for u, n in picked.items())
    plan = log.pick(spark.createDataFrame([("n7",)], "key string"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    monkeypatch.setattr(keyed, "LEAST_TAIL", 10)
    assert log.due()
    log.compact()
    assert not log.due() and log.generation() == 2
    assert {r.uuid: r.content for r in log.state().collect()} == {u: c for u, (c, _) in want.items()} and counts() == full


def test_sequence_numbers_repeat_for_a_repeated_batch(spark, tmp_path):
    s = Sequence(spark, f"{tmp_path}/s")
    assert [s.number("a", 0), s.number("b", 0), s.number("a", 1), s.number("b", 0), Sequence(spark, f"{tmp_path}/s").number("a", 2)] == [0, 1, 2, 1, 3]


def test_streams_share_a_sequence_and_leave_nothing_behind(spark, tmp_path, monkeypatch):
    shared = Path(f"{tmp_path}/shared")
    shared.mkdir()
    before = spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr("memweave.runtime.shared_dir", lambda s: str(shared))
    nodes, edges = KeyedLog(spark, f"{tmp_path}/nodes", buckets=4, names=True), KeyedLog(spark, f"{tmp_path}/edges", key="subject_uuid", buckets=4)
    (tmp_path / "in").mkdir()
    (tmp_path / "runs").mkdir()
    left = []
    for turn in range(3):
        row = {"entry_id": str(turn), "text": "Ada works at Lab.", "user_id": "u", "at": f"2024-01-0{turn + 1}T00:00:00Z"}
        (tmp_path / f"in/{turn}.json").write_text(json.dumps(row))
        ingest_stream.start(spark, f"{tmp_path}/in", nodes, edges, f"{tmp_path}/cp", schema.PREDICATES).awaitTermination(120)
        if turn == 0:
            (tmp_path / "runs/1.json").write_text(json.dumps({"user_id": "u", "at": "2024-01-01T12:00:00Z"}))
            ingest_stream.start_consolidation(spark, f"{tmp_path}/runs", nodes, edges, f"{tmp_path}/cp2", schema.PREDICATES).awaitTermination(120)
        left.append(len(list(shared.iterdir())))
    assert left == [0, 0, 0] and before == spark.conf.get("spark.checkpoint.dir")
    fact = edges.state().where("content = 'Ada works_at Lab'").first()
    assert edges.journal().where(F.col("uuid") == fact.uuid).count() >= 3 and fact.created_at.day == 1 and fact.updated_at.day == 3
    numbers = [r.number for r in spark.read.parquet(f"{tmp_path}/nodes_sequence").collect()]
    assert sorted(numbers) == [0, 1, 2, 3]


def test_plain_logs_still_serve_streams(spark, tmp_path):
    nodes, edges = ChangeLog(spark, f"{tmp_path}/nodes"), ChangeLog(spark, f"{tmp_path}/edges")
    (tmp_path / "in").mkdir()
    for turn in range(2):
        (tmp_path / f"in/{turn}.json").write_text(json.dumps({"entry_id": str(turn), "text": "Bob knows Ada.", "user_id": "u", "at": f"2024-01-0{turn + 1}T00:00:00Z"}))
        ingest_stream.start(spark, f"{tmp_path}/in", nodes, edges, f"{tmp_path}/cp", schema.PREDICATES).awaitTermination(120)
    fact = edges.state().first()
    assert fact.updated_at.day == 2 and fact.created_at.day == 1 and len(fact.journal_entry_ids) == 2


def counting(path, empty=(), fail=()):
    """A model that notes each call in a file, and may answer nothing below a budget, or fail."""

    def make():
        def run(requests):
            out = []
            for r in requests:
                with open(path, "a") as f:
                    f.write(f"{r.user}|{r.max_tokens}\n")
                if r.user in fail:
                    raise RuntimeError("no")
                out.append("" if r.user in empty and r.max_tokens < 40 else f"said {r.user}")
            return out

        return run

    return make


def test_answers_are_asked_for_once(spark, tmp_path, monkeypatch):
    from memweave.operators import answers

    monkeypatch.setattr(answers, "CALLS", 3)
    calls = lambda: Path(f"{tmp_path}/calls").read_text().split()
    table = answers.AnswerTable(spark, f"{tmp_path}/answers")
    df = spark.createDataFrame([(k, f"p{k % 20}") for k in range(60)], "k int, p string")
    model = answers.with_budgets(counting(f"{tmp_path}/calls", empty={"p3"}))
    got = table.ask(df, F.col("p"), "said", model, max_tokens=10, in_flight=2).collect()
    assert all(r.said == f"said {r.p}" and r.said_error is None for r in got) and len(got) == 60
    assert sorted(calls()) == sorted([f"p{k}|10" for k in range(20)] + ["p3|20", "p3|40"])
    again = table.ask(df, F.col("p"), "said", model, max_tokens=10).collect()
    assert {(r.k, r.said) for r in again} == {(r.k, r.said) for r in got} and len(calls()) == 22


def test_a_killed_task_causes_no_second_call(spark, tmp_path, monkeypatch):
    """A worker that dies in the middle of its slices: its retry calls only for what was not stored."""
    import os

    from memweave.operators import answers

    monkeypatch.setattr(answers, "CALLS", 1)
    flag, log = f"{tmp_path}/died", f"{tmp_path}/calls"
    inner = counting(log)

    def make():
        model = inner()

        def run(requests):
            if os.path.exists(log) and len(open(log).read().split()) == 6 and not os.path.exists(flag):
                open(flag, "w").close()
                raise SystemExit("killed")
            return model(requests)

        return run

    table = answers.AnswerTable(spark, f"{tmp_path}/answers")
    df = spark.createDataFrame([(f"p{k}",) for k in range(12)], "p string").coalesce(1)
    ask = lambda: table.ask(df, F.col("p"), "said", make, parallel=1).collect()
    try:
        got = ask()
    except Exception:  # a local master does not retry a task: the job runs again
        got = ask()
    assert os.path.exists(flag) and {r.said for r in got} == {f"said p{k}" for k in range(12)}
    assert len(Path(log).read_text().split()) == 12


def test_failures_are_told_and_asked_again(spark, tmp_path):
    from memweave.operators import answers

    table = answers.AnswerTable(spark, f"{tmp_path}/answers")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    first = {r.p: (r.said, r.said_error) for r in table.ask(df, F.col("p"), "said", counting(f"{tmp_path}/calls", fail={"b"})).collect()}
    assert first == {"a": ("said a", None), "b": (None, "RuntimeError: no"), None: ("said ", None)}
    second = {r.p: r.said for r in table.ask(df, F.col("p"), "said", counting(f"{tmp_path}/calls")).collect()}
    assert second == {"a": "said a", "b": "said b", None: "said "}


def test_ingest_computes_what_is_read(spark, monkeypatch):
    """Tombstones alone: no journals of nodes and facts are grouped, and triples are resolved once."""
    from memweave.operators import ingest

    labels, real = [], ingest.materialize
    monkeypatch.setattr(ingest, "materialize", lambda df, label: (labels.append(label), real(df, label))[1])
    rows = [(f"e{k}", "text", "u", "general", None, f"2024-01-0{k + 1}", f"status: ok\ntriples:\nSELF | has_status | state {k}") for k in range(3)]
    entries = spark.createDataFrame(rows, "entry_id string, text string, user_id string, domain string, source string, at string, answer string").withColumn("at", F.col("at").cast("timestamp"))
    nodes = spark.createDataFrame([], "uuid string, content string, node_type string")
    none = spark.createDataFrame([], "uuid string, user_id string, subject_uuid string, content string, updated_at timestamp")
    done = ingest.ingest(entries, nodes, ["has_status"], answers={"extract": "answer", "supersede": F.expr("facts[0].uuid")}, edges=none)
    assert done.tombstones.count() == 2
    assert "entities" not in labels and "facts" not in labels and labels.count("resolved-triples") == 1
    assert done.edges.count() == 3 and done.nodes.count() == 4 and done.acks.count() == 9
    assert labels.count("entities") == 1 and labels.count("facts") == 1


def test_acknowledgements_group_no_journals_and_unasked_facts_are_not_ranked(spark, monkeypatch):
    """Acknowledgements alone write no entities; without answers on supersession nothing is replaced, and no newest facts are looked for."""
    from memweave.operators import ingest

    labels, real = [], ingest.materialize
    monkeypatch.setattr(ingest, "materialize", lambda df, label: (labels.append(label), real(df, label))[1])
    monkeypatch.setattr(ingest.recent, "newest", lambda *args: pytest.fail("newest facts are ranked"))
    rows = [(f"e{k}", "text", "u", "general", None, f"2024-01-0{3 - k}", "status: ok\ntriples:\nSELF | has_status | state\nSELF | has_status | known") for k in range(3)]
    entries = spark.createDataFrame(rows, "entry_id string, text string, user_id string, domain string, source string, at string, answer string").withColumn("at", F.col("at").cast("timestamp"))
    known = "entity_" + hashlib.sha1(b"generic:known").hexdigest()
    nodes = spark.createDataFrame([(known, "known", "generic")], "uuid string, content string, node_type string")
    none = spark.createDataFrame([], "uuid string, user_id string, subject_uuid string, content string, updated_at timestamp")
    done = ingest.ingest(entries, nodes, ["has_status"], answers={"extract": "answer"}, edges=none)
    acks = sorted((r.entry_id, r.kind, r.id) for r in done.acks.collect())
    assert "entities" not in labels and done.tombstones.count() == 0
    assert len(acks) == 15 and [a[0] for a in acks if a[1] == "created"] == ["e2", "e2"]  # the earliest entry
    assert {a[1] for a in acks if a[2] == known} == {"updated"} and sum(a[1] == "fact" for a in acks) == 6
