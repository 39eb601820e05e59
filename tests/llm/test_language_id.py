import zlib

import numpy as np
import public_tokenizers

from memweave.llm import language_id as lid

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01/documents.parquet"


class Tiny(lid.Pieces):
    def __init__(self, words):
        self.number = {w: k + 1 for k, w in enumerate(words)}
        self.unknown, self.size, self.longest = len(words) + 1, len(words) + 2, max(map(len, words))


def every(word, known, prob):
    """(product, pieces) of every segmentation."""
    if not word:
        yield 1.0, []
    for n in range(1, len(word) + 1):
        p = known.number.get(word[:n], known.unknown if n == 1 else None)
        if p is not None:
            for q, rest in every(word[n:], known, prob):
                yield prob[p] * q, [p, *rest]


def test_forward_and_expected_counts_sum_over_all_segmentations():
    known = Tiny(["a", "b", "ab", "ba", "aba", "bb", "abab"])
    prob = np.random.default_rng(3).random((known.size, 2))
    prob[0] = 0
    for word in ("a", "abab", "aabba", "abcab", "bababab"):
        got = lid.forward(known.grid([word, word]), prob)
        for lang in range(2):
            ways = list(every(word, known, prob[:, lang]))
            assert np.isclose(np.exp(got[1, lang]), sum(q for q, _ in ways))
            want = np.zeros(known.size)
            for q, used in ways:
                np.add.at(want, used, q)
            want /= sum(q for q, _ in ways)
            assert np.allclose(lid.expected(known.grid([word]), prob[:, lang], np.ones(1)), want)


def test_long_words_do_not_underflow():
    known = lid.pieces(PATH)
    got = lid.forward(known.grid(["q" * 20_000]), np.full((known.size, 1), 1e-5))
    assert np.isfinite(got).all() and got[0, 0] < -1000


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    rows = {r.doc_id: r for r in docs.collect()}
    got = lid.identify(docs, PATH).collect()
    assert len(got) == len(rows)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    test = [g for g in got if g.held_out]
    assert np.mean([g.lang_pred == rows[g.doc_id].lang for g in test]) >= 0.97
    assert all(0 <= g.score <= 1 for g in got)


def test_edges(spark):
    words = {"en": "the house is very old and the dog sleeps there", "de": "das Haus ist sehr alt und der Hund schläft dort"}
    rows = [(i, words[lang], lang, "x") for i in range(20) for lang in words]
    rows += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "123 !?", "en", "x"), (None, "der Hund", "de", "x"), (103, "the dog", None, None), (104, "das " * 50_000, "de", "x"), (105, "ЖЖ", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = lid.identify(df, PATH).collect()
    by = {g.doc_id: (g.lang_pred, g.held_out) for g in got}
    assert len(got) == len(rows)
    assert [by[k][0] for k in (100, 101, 102)] == ["und"] * 3
    assert by[None] == ("de", False) and by[103][0] == "en" and by[104][0] == "de" and by[105][0] in ("de", "en")
    nothing = lid.identify(df.where("lang IS NULL"), PATH).collect()
    assert {g.lang_pred for g in nothing} == {"und"}
    assert lid.identify(df.limit(0), PATH).count() == 0
    marked = lid.annotate(df, lid.train(df, PATH)).collect()
    assert sorted(str((m.doc_id, m.lang_pred)) for m in marked) == sorted(str((g.doc_id, g.lang_pred)) for g in got)
