import hashlib
import random

import numpy as np

from memweave.llm import line_dedup
from memweave.llm import suffix_dedup as sd


def brute(rows, window):
    """Rows are (doc_id, text), repeats of both taken once."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest(), r[1] is None))
    seen, result = set(), {}
    for d, t in order:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        result[d, t] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted([(d, *result[d, t]) for d, t in rows], key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = "ab é" if seed % 2 else "the quick brown fox jumps, ÄÖß日"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(60, 400)) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = [rng.choice([word(rng.randint(0, 150)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :], "z" * rng.randint(0, 400), "xy" * rng.randint(0, 120)]) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    return texts + texts[:6]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    return sorted((tuple(r) for r in sd.suffix_dedup(df, **more).collect()), key=str)


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        ids = random.Random(seed).sample(range(-50, 500), len(texts))
        rows = list(zip(ids, texts))
        assert run(spark, rows) == brute(rows, 100)


def test_repeated_and_missing_ids_and_a_long_text(spark):
    texts = corpus(4)
    rows = [(5, texts[0] * 3), (5, texts[1] * 2), (5, texts[1] * 2), (None, texts[0] * 3), (None, None), (7, None), (8, ""), (9, "q" * 99), (10, "q" * 100), (11, "q" * 70_000), (12, texts[2])]
    assert run(spark, rows) == brute(rows, 100)


def test_blocks_of_a_long_text(monkeypatch):
    from memweave.llm import anchors

    texts = [np.frombuffer(t.encode(), np.uint8) for t in ["".join(corpus(3)), *corpus(1)]]
    want = [(k, p) for k, t in enumerate(texts) for p in range(len(t) - 99)]
    sets = []
    for block in (1 << 20, 150):
        monkeypatch.setattr(anchors, "BLOCK", block)
        own, lo, n, gram, _ = anchors.anchors_of(texts)
        assert [(k, p) for k, a, m in zip(own.tolist(), lo.tolist(), n.tolist()) for p in range(a, a + m)] == want
        sets.append([g for g, m in zip(gram.tolist(), n.tolist()) for _ in range(m)])
        assert len(anchors.places(texts[0])) == len(texts[0]) - 99
    assert sets[0] == sets[1]  # a window's gram does not depend on the block
    # equal windows have equal grams
    seen = {}
    for (k, p), g in zip(want, sets[0]):
        assert seen.setdefault(texts[k][p : p + 100].tobytes(), g) == g


def test_empty(spark):
    assert run(spark, []) == []


def test_suffix_ranks(spark):
    rng = random.Random(2)
    for length in (1, 3, 4, 13):
        rows = [(i, [rng.choice([-(1 << 63), -1, 0, 5]) if k < length - 3 else rng.choice([0, 1]) for k in range(length)]) for i in range(80)]
        got = {r.id: r.rank for r in sd.suffix_ranks(spark.createDataFrame(rows, "id long, chars array<long>"), length).collect()}
        order = sorted(rows, key=lambda r: r[1])
        assert len(got) == 80
        for (i, x), (j, y) in zip(order, order[1:]):
            assert (got[i] == got[j]) if x == y else (got[i] < got[j])


def test_remove_repeats_keeps_rows_and_columns(spark):
    texts = corpus(2)
    rows = [*enumerate(texts), (None, texts[0]), (3, None)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, hash string")
    got = sd.remove_repeats(df)
    assert got.columns == df.columns and got.count() == len(rows)
    lengths = {(d, h): n for (d, n, *_), h in zip(brute(rows, 100), "h" * len(rows))}
    assert len(lengths) == len({r[0] for r in rows})
    first = {r.doc_id: r.text for r in got.collect()}
    assert first[0] == texts[0] or len(first[0]) < len(texts[0])


def test_texts_in_parts(spark, monkeypatch):
    """Any length goes: texts of several parts, with their ids as numbers and without."""
    monkeypatch.setattr(sd, "PART_BITS", 8)
    texts = corpus(7)
    for ids in (range(len(texts)), [-1, None, *range(7, 7 * len(texts), 7)]):
        rows = list(zip(ids, texts))
        assert run(spark, rows) == brute(rows, 100)
    big = [(1 << 50, texts[0] + texts[1]), (3, texts[1] * 2), (3, texts[1] * 2)]
    assert run(spark, big) == brute(big, 100)


def test_columns_of_any_name(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text, "a", "b", 1), (2, text + "x", "c", "d", 2)], "doc_id long, text string, __cut string, cut string, `id` long")
    for f in (sd.remove_repeats, line_dedup.remove_lines):
        got = {r.doc_id: tuple(r) for r in f(df).collect()}
        assert f(df).columns == df.columns and got[1] == (1, text, "a", "b", 1) and got[2][2:] == ("c", "d", 2)


def test_large_sides_are_not_sorted(spark, monkeypatch):
    """Anchors and texts meet distinct keys by hash; only the keys are held."""
    plans = {}

    def keep(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    real = sd.materialize
    monkeypatch.setattr(sd, "materialize", keep)
    texts = corpus(5)
    assert run(spark, list(enumerate(texts))) == brute(list(enumerate(texts)), 100)
    joined = ["anchors", "anchor-repeats", "anchor-open", "segments", "unit-repeats", "unit-open", "strings", "open-repeats"]
    assert all("ShuffledHashJoin" in plans[k] and "SortMergeJoin" not in plans[k] for k in joined)
