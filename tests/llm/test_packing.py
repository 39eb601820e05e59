import itertools
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from memweave.llm import packing


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=30), st.integers(1, 5))
def test_bounds_are_optimal(lengths, buckets):
    c = Counter(lengths)
    values = sorted(c)
    got = packing.optimal_bounds(np.array(values), np.array([c[v] for v in values]), buckets)
    every = [x for n in range(1, buckets + 1) for x in itertools.combinations(values, n) if x[-1] == values[-1]]
    assert len(got) <= buckets and got[-1] == values[-1] and got == sorted(got)
    assert padding(lengths, got) == min(padding(lengths, x) for x in every)


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 30)
    rng = np.random.default_rng(2)
    rows = [(int(i), "w " * int(n), 1) for i, n in enumerate(rng.integers(0, 120, 300))] + [(None, "a b", 1), (5, "a b", 1), (5, "a b", 1), (700, None, 1), (701, "", 1), (702, "x " * 1050, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch int")
    got = packing.pack(df, max_len=100, buckets=5, budget=400).collect()
    want = Counter()
    for i, t, _ in rows:
        n = len((t or "").split())
        want.update((i, k, min(100, n - 100 * k)) for k in range(max(1, -(-n // 100))))
    assert Counter((r.doc_id, r.piece, r.n_tokens) for r in got) == want
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append((t or "").split())
    for r in got:
        assert any(t[100 * r.piece : 100 * r.piece + 100] == next(x for j, x, _ in rows if j == r.doc_id and len((x or "").split()) == len(t))[r.start : r.end].split() for t in texts[r.doc_id] if r.n_tokens) or not r.n_tokens
    lengths = Counter(r.n_tokens for r in got if r.n_tokens)
    values = sorted(lengths)
    bounds = packing.optimal_bounds(np.array(values), np.array([lengths[v] for v in values]), 5)
    batches = {}
    for r in got:
        assert (r.bucket_len is None) == (r.n_tokens == 0)
        if r.n_tokens:
            assert r.bucket_len == min(b for b in bounds if b >= r.n_tokens) and r.padding == r.bucket_len - r.n_tokens
            batches.setdefault((r.bucket_len, r.batch), []).append(r.row)
    for (bound, batch), places in batches.items():
        assert sorted(places) == list(range(len(places))) and len(places) * bound <= max(400, bound)
        if (bound, batch + 1) in batches:
            assert len(places) == max(1, 400 // bound)


def test_length_column_and_empty(spark):
    df = spark.createDataFrame([(1, "x", 7), (2, None, None)], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_tokens, r.bucket_len, r.batch) for r in packing.pack(df, length="n").collect()}
    assert got == {1: (7, 7, 0), 2: (0, None, None)}
    assert packing.pack(df.limit(0)).count() == 0


def test_padded_ids_are_the_encoders(spark):
    import public_tokenizers

    from memweave.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(k, " ".join(f"word{j} of text {k}." for j in range(k * 3))) for k in range(12)] + [(50, None), (51, "x " * 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    tokens = bpe.encode(df, path)
    got = packing.padded_ids(packing.pack(tokens, max_len=64, buckets=4, budget=512, ids="ids"), tokens, pad_id=-1).collect()
    want = {r.doc_id: list(r.ids) for r in tokens.collect()}
    parts = {}
    for r in got:
        assert len(r.input_ids) == (r.bucket_len or 0) and r.input_ids[r.n_tokens :] == [-1] * (r.padding or 0)
        parts.setdefault(r.doc_id, {})[r.piece] = r.input_ids[: r.n_tokens]
    assert {k: sum((p[j] for j in sorted(p)), []) for k, p in parts.items()} == want


def test_encoded_sequences_are_the_encoders_and_runs_agree(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k % 9, " ".join(f"word{j} of text {k}." for j in range(k * 3))) for k in range(30)] + [(50, None), (50, "x " * 400), (None, "same"), (None, "also")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [[tuple(r) for r in packing.pack(df.repartition(n), max_len=64, buckets=4, budget=512, vocabulary=path, pad_id=-1).collect()] for n in (1, 5)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    encoder = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids
        want.update((i, k // 64, tuple(ids[k : k + 64])) for k in range(0, max(1, len(ids)), 64))
    at = packing.pack(df, vocabulary=path).columns.index
    assert Counter((r[at("doc_id")], r[at("piece")], tuple(r[at("input_ids")][: r[at("n_tokens")]])) for r in runs[0]) == want
    assert all(len(r[at("input_ids")]) == (r[at("bucket_len")] or 0) for r in runs[0])
