import difflib
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from memweave.llm import line_dedup as ld


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=14), st.lists(st.sampled_from("abcdefg"), max_size=14))
def test_alignment_is_increasing_and_of_equal_lines(a, b):
    got = ld.patience(a, b)
    assert all(a[i] == b[k] for i, k in got)
    assert all(i < j and k < m for (i, k), (j, m) in zip(got, got[1:]))
    if a == b:
        assert len(got) == len(a)


def test_unique_lines_lead():
    a, b = list("xAyBz"), list("AqBw")
    assert ld.patience(a, b) == [(1, 0), (3, 2)]
    assert ld.blocks([(0, 3), (1, 4), (2, 6), (4, 7), (5, 8)]) == [(3, 5), (6, 7), (7, 9)]
    assert difflib.SequenceMatcher(None, a, b, False).ratio() > 0


def brute(rows, rare, least):
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest(), r[1] is None))
    lines = [t.split("\n") if t is not None else [] for _, t in order]
    holders = {}
    for k, own in enumerate(lines):
        for x in {x for x in own if x.strip()}:
            holders.setdefault(x, []).append(k)
    pairs = set()
    for h in holders.values():
        pairs |= {(a, b) for a in h for b in h if a < b} if len(h) <= rare else {(h[0], b) for b in h[1:]}
    gone = {k: set() for k in range(len(order))}
    for a, b in pairs:
        gone[b] |= set(ld.common_blocks(lines[a], lines[b], [len(x.strip()) for x in lines[b]], least))
    out = {}
    for k, r in enumerate(order):
        kept = "\n".join(x for i, x in enumerate(lines[k]) if i not in gone[k])
        out[r] = (len(lines[k]), len(gone[k]), hashlib.sha256(kept.encode()).hexdigest())
    return sorted([(r[0], *out[r]) for r in rows], key=str)


def corpus(seed, n=50):
    rng = random.Random(seed)
    pool = [f"line {i} " + "abc " * rng.randint(0, 20) for i in range(60)] + ["", "  "]
    texts = []
    for _ in range(n):
        own = [rng.choice(pool) if rng.random() < 0.4 else f"own {rng.random()} " + "d" * rng.randint(0, 60) for _ in range(rng.randint(0, 12))]
        if texts and rng.random() < 0.3:
            own += rng.choice(texts).split("\n")[:5]
        texts.append("\n".join(["common header line of every single document here!", *own]))
    return texts


def test_against_brute_force(spark):
    for seed in (2, 8):
        texts = corpus(seed)
        rows = [*zip(random.Random(1).sample(range(999), len(texts)), texts), (None, texts[0]), (2000, None), (2001, ""), (2002, texts[1]), (2002, texts[2]), (2002, texts[2]), (2003, "x\n" * 20_000)]
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone int")
        assert sorted(map(tuple, ld.line_dedup(df).collect()), key=str) == brute(rows, len(rows), ld.MIN_CHARS)


def test_rows_and_columns_stay(spark):
    texts = corpus(3)
    df = spark.createDataFrame([(k, t, "g", "h") for k, t in enumerate(texts)], "doc_id long, text string, gone string, tid string")
    got = ld.remove_lines(df)
    assert got.columns == df.columns
    sha = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in got.collect()}
    assert sha == {r.doc_id: r.kept_sha256 for r in ld.line_dedup(df).collect()}
    assert ld.line_dedup(df.limit(0)).count() == 0 and ld.remove_lines(df.limit(0)).count() == 0


def test_all_pairs_without_a_cap(spark):
    a, b, c = ("a line of thirty characters: " + x for x in "abc")
    # each first holder of a and b has one line of the block; c before b hides b in the second
    texts = [f"{a}\nx", f"{b}\ny", f"{c}\n{b}\n{a}", *(f"own {i}\n{a}\n{b}\n{c}\nend {i}" for i in range(12))]
    repeated = "a line of more than fifty characters that one text holds many times over"
    moved = "another line of more than fifty characters, before it in one and after it in others"
    texts += [f"{repeated}\n{moved}", *(f"{moved}\nz {i}\n{repeated}\n{repeated}" for i in range(12)), *(f"{moved}\nz {i}\n{repeated}" for i in range(12))]
    for n, many in enumerate((texts, corpus(2), corpus(8), corpus(5, 120))):
        rows = [*enumerate(many), (None, many[0]), (2000, None), (2001, ""), (2002, "\n" * 500)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        want = brute(rows, len(rows), ld.MIN_CHARS)
        assert sorted(map(tuple, ld.line_dedup(df).collect()), key=str) == want
        assert n == 3 or want != brute(rows, 8 if n != 1 else 2, ld.MIN_CHARS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefxyz"), max_size=14), st.lists(st.sampled_from("abcdefg"), max_size=14))
def test_lines_of_others_do_not_matter(a, b):
    assert ld.common_blocks(ld.shared_part(a, set(b)), b, [1] * len(b), 2) == ld.common_blocks(a, b, [1] * len(b), 2)


def test_lines_that_a_fast_hash_confuses(spark):
    from tests.llm.test_minhash import confused

    rows = [(k, f"own line {k}\n{x}") for k, x in enumerate(confused())]
    got = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_open_runs_meet_one_of_each_sequence(spark):
    """Small values of what is rare and of what stands for a sequence: the rest of the pairs is exact, and far from all pairs."""
    one, two = "a line of more than fifty characters, at the start and at the end", "another line of more than fifty characters, here and there in texts"
    texts = [f"{one}\nx {k}" for k in range(40)] + [f"y {k}\n{one}" for k in range(40)] + [f"{one}\nz {k}\n{one}" for k in range(40)]
    texts += [f"{two}\n{one}\nkin {k % 4}\n{one}\n{two}" for k in range(30)] + [f"u {k}\n{two}\nv {k}\n{one}\n{two}" for k in range(30)]
    random.Random(4).shuffle(texts)
    for many, rare, first in ((texts, 1, 1), (texts, ld.RARE, ld.FIRST), (corpus(5, 120), 1, 2)):
        df = spark.createDataFrame([*enumerate(many)], "tid long, text string")
        lines = [t.split("\n") for t in many]
        want = {}
        for b, own in enumerate(lines):
            gone = {k for a in lines[:b] for k in ld.common_blocks(a, own, [len(x.strip()) for x in own], ld.MIN_CHARS)}
            if gone:
                want[b] = gone
        assert {r.tid: set(r.gone) for r in ld.removed_lines(df, rare=rare, first=first).collect()} == want
    table = ld.materialize(ld._line_table(spark.createDataFrame([(k, f"{one}\nz {k}\n{one}") for k in range(400)], "tid long, text string")), "lines")
    run = ld._runs_of(table, ld.MIN_CHARS)
    shared = run.join(run.groupBy("run").count().where("count > 1").select("run"), "run").selectExpr("tid", "run", "0L AS seen")
    assert ld._other_pairs(table, shared, shared.where("tid > 0"), 20, 3).count() < 2000
