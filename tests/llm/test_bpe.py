import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
HF = Tokenizer.from_file(PATH)
ODD = ["", "a<|endoftext|>b  <|endoftext|>", "  x\n\n y\x1c\x1d z\x85q\xa0 r", "I'll 'S don't 123 ½²³ ٣ 日本語", "a" * 5000, "é​  　x", "﻿😀👨‍👩‍👧 \x00\x01", "   ", "\t\tx\r\n", "ab " * 3000]


def same(texts):
    model = bpe.load(PATH)
    for t, ids in zip(texts, model.encode_batch(texts), strict=True):
        want = HF.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids) == HF.decode(want, skip_special_tokens=False)


def test_odd_texts():
    same(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 'sthe\n\t.!1"), st.characters(codec="utf-8", max_codepoint=0x2FFF))), max_size=5))
def test_random_texts(texts):
    same(texts)


def test_bytes_that_are_no_text():
    model = bpe.load(PATH)
    ids = HF.encode("é😀", add_special_tokens=False).ids[:-1]
    assert model.decode(np.array(ids, "<u4").tobytes()) == HF.decode(ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        model.decode(np.array([99_999_999], "<u4").tobytes())


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    model = bpe.ByteBPE(PATH)
    assert [model.encode_batch(["the cat sat on  a mat"])[0] for _ in range(3)] == [model.encode_batch(["the cat sat on  a mat"])[0]] * 3


def test_columns(spark):
    rows = [(k, t, 1) for k, t in enumerate([*ODD, None])] + [(None, "the cat", 1), (0, "the cat", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = lambda t: HF.encode(t or "", add_special_tokens=False).ids
    want = sorted([(i, len(ids(t)), sha(np.array(ids(t), "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows], key=str)
    assert sorted(map(tuple, bpe.round_trip(df, PATH).collect()), key=str) == want
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(i, t or "") for i, t, _ in rows], key=str)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
