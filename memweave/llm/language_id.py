"""Language identification by segmentation-marginalised unigrams.

A language is a unigram model over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces (forward algorithm); a
text's is the product over its words. The piece probabilities come from expectation
maximisation with the same sum (forward-backward) over labelled words, in Spark: word
counts by language, then expected piece counts by task, summed by a shuffle. What
reaches the driver is a table of at most pieces x languages.

Training reads about ``TRAIN_ROWS`` rows of each language, chosen by hash: the bound on
the fitting sample. Prediction reads whole texts, and no other column.

Defined results: ``und`` with score 0 for a null text, a text without letters, or where
no language was learned. The score is the posterior of the predicted language with
equal priors; ties go to the first language in alphabetical order. Rows whose doc_id or
lang is null teach nothing, and a null doc_id is not held out.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memweave.llm.bpe import groups
from memweave.llm.remembered import remembered, rest
from memweave.runtime import materialize, release

TRAIN_ROWS = 2000
EM_ROUNDS = 3
SMOOTHING = 0.05
#: Probability of a character that is no piece.
UNKNOWN = 1e-7
#: Words in training are cut to runs of so many characters; words to score are not.
RUN = 32
CACHE = 300_000
#: Characters that are taken apart into words at once.
AT_ONCE = 1 << 20
#: Cut off around words, so that a word is scored once for all its surroundings.
PUNCTUATION = ".,;:!?|()[]\"'«»¿¡#$&%*-"
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


SLOTS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS)).astype(np.int64)


class Pieces:
    """The vocabulary's ordinary pieces, numbered from 1; 0 is none and the last is the unknown character."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.number = {p: k + 1 for k, p in enumerate(ordinary)}
        self.unknown = len(ordinary) + 1
        self.size = len(ordinary) + 2
        self.longest = max(map(len, ordinary))

    def _index(self) -> None:
        """The pieces' hashes, sorted by their slot of a table that is mostly empty."""
        hashes = np.zeros(len(self.number), np.uint64)
        for k, p in enumerate(self.number):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = h
        order = np.argsort(_slot(hashes), kind="stable")
        self.hashes = np.append(hashes[order], np.uint64(0))
        self.ids = np.append(np.array(list(self.number.values()), np.int32)[order], np.int32(0))
        counts = np.bincount(_slot(hashes), minlength=1 << SLOTS)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)
        self.deep = int(counts.max())

    def grid(self, words: list[str]) -> np.ndarray:
        """Piece number of every substring that ends at i and has L characters: [word, i, L], for words of one length."""
        if not hasattr(self, "hashes"):
            self._index()
        n = len(words[0])
        most = min(n, self.longest)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out = np.zeros((len(words), n + 1, most + 1), np.int32)
        h = np.zeros((len(words), n), np.uint64)
        for size in range(1, most + 1):
            h = h[:, : n - size + 1] * _BASE + codes[:, size - 1 :]
            at = self.first[_slot(h)]
            for k in range(self.deep):
                spot = np.minimum(at + k, len(self.hashes) - 1)
                hit = self.hashes[spot] == h
                out[:, size:, size][hit] = self.ids[spot[hit]]
        one = out[:, 1:, 1]
        one[one == 0] = self.unknown
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def forward(grid: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Log probability [word, language] by summing over all segmentations; ``prob`` is [piece, language].

    Sums are scaled at each character, so that long words do not underflow.
    """
    words, ends, sizes = grid.shape
    n, most = ends - 1, sizes - 1
    log = np.zeros((words, prob.shape[1]))
    recent = [np.ones((words, prob.shape[1]))]  # the latest ``most`` sums, newest last
    for i in range(1, n + 1):
        now = np.zeros_like(log)
        for size in range(1, min(i, most) + 1):
            p = grid[:, i, size]
            if size == 1 or p.any():
                now += recent[-size] * prob[p]
        scale = now.copy()
        log += np.log(scale)
        recent = [r / scale for r in recent[-(most - 1) :]] if most > 1 else []
        recent.append(np.ones_like(now))
    return log


def expected(grid: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of short words of one language; ``prob`` is [piece]."""
    words, ends, sizes = grid.shape
    n, most = ends - 1, sizes - 1
    ahead = np.zeros((n + 1, words))
    back = np.zeros((n + 1, words))
    ahead[0] = back[n] = 1
    p = prob[grid]
    for i in range(1, n + 1):
        for size in range(1, min(i, most) + 1):
            ahead[i] += ahead[i - size] * p[:, i, size]
    for i in range(n, 0, -1):
        for size in range(1, min(i, most) + 1):
            back[i - size] += back[i] * p[:, i, size]
    out = np.zeros(len(prob))
    for i in range(1, n + 1):
        for size in range(1, min(i, most) + 1):
            np.add.at(out, grid[:, i, size], ahead[i - size] * p[:, i, size] * back[i] / ahead[n] * weight)
    out[0] = 0
    return out


@dataclass
class Model:
    vocabulary: str
    languages: list[str]
    prob: np.ndarray  # [piece, language]; row 0 is zero


def units(token: str) -> list[str]:
    """A run of text without spaces: the word, with the vocabulary's mark of a start, and the punctuation around it."""
    core = token.strip(PUNCTUATION)
    if not core:
        return ["▁" + token]
    a = token.index(core)
    return [x for x in (token[:a], "▁" + core, token[a + len(core) :]) if x]


def _word_counts(train: DataFrame) -> DataFrame:
    """``(lang, word, n)`` with a partial count in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for token in text.as_py().split():
                    for w in units(token):
                        for k in range(0, len(w), RUN):
                            counts[lang, w[k : k + RUN]] += 1
            yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    return train.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _em_round(counts: DataFrame, model: Model) -> Model:
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = pieces(m.vocabulary)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[tuple[str, int], list[tuple[str, int]]] = defaultdict(list)
            for lang, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by[lang, len(w)].append((w, n))
            for (lang, _), rows in by.items():
                p = m.prob[:, m.languages.index(lang)]
                for k in range(0, len(rows), 2000):
                    part = rows[k : k + 2000]
                    got = expected(known.grid([w for w, _ in part]), p, np.array([n for _, n in part], float))
                    sums[lang] = sums.get(lang, 0) + got
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at])], names=["lang", "piece", "n"])

    sums = counts.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    got = np.zeros_like(model.prob)
    for r in sums.toLocalIterator():  # at most pieces x languages rows
        got[r.piece, model.languages.index(r.lang)] = r.n
    shared.unpersist()
    return Model(model.vocabulary, model.languages, _normal(got))


def _normal(counts: np.ndarray) -> np.ndarray:
    p = counts + SMOOTHING
    p[[0, -1]] = 0
    p /= p.sum(0)
    p[-1] = UNKNOWN
    return p


def train(docs: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS, rounds: int = EM_ROUNDS) -> Model:
    """Fit on ``docs (doc_id, text, lang)``, less the held-out rows, with about ``rows`` rows a language."""
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(counts)
    size = pieces(vocabulary).size
    model = Model(vocabulary, languages, _normal(np.ones((size, len(languages)))))
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows / counts[lang]))])
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    words = materialize(_word_counts(sample.select("lang", "text")), "words")
    for _ in range(rounds):
        model = _em_round(words, model)
    release(words)
    return model


class Scorer:
    """Sums of word scores, with remembered words."""

    def __init__(self, model: Model):
        self.model = model
        self.pieces = pieces(model.vocabulary)
        self.row: dict[str, int] = {}
        self.log = np.zeros((0, len(model.languages)), np.float64)

    def learn(self, tokens: list[str]) -> None:
        split = [units(t) for t in tokens]
        by: dict[int, list[str]] = defaultdict(list)
        for u in set().union(*split):
            by[len(u)].append(u)
        at: dict[str, int] = {}
        parts = []
        for size, same in by.items():
            step = max(1, 200_000 // (size * min(size, self.pieces.longest)))
            for k in range(0, len(same), step):
                parts.append(forward(self.pieces.grid(same[k : k + step]), self.model.prob))
            for u in same:
                at[u] = len(at)
        logs = np.concatenate(parts)
        ends = np.cumsum([len(s) for s in split])
        summed = np.add.reduceat(logs[[at[u] for s in split for u in s]], np.concatenate([[0], ends[:-1]]), axis=0)
        for t in tokens:
            self.row[t] = len(self.row)
        self.log = np.concatenate([self.log, summed])

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.row) > CACHE:
            self.row, self.log = {}, self.log[:0]
        split = [t.split() if self.model.languages and LETTER.search(t) else [] for t in texts]
        if split and (new := list(set().union(*split).difference(self.row))):
            self.learn(new)
        out = []
        get = self.row.__getitem__
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.log[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _scorer(token: str, model: Model) -> Scorer:
    """One scorer for each worker process and job, so that its tasks share the remembered words."""
    return remembered(("language_id", token), lambda: Scorer(model))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row. No shuffle."""
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(token, shared.value)
        for keys, texts in groups(batches, AT_ONCE):
            got = scorer.score(texts)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])
        rest()

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def annotate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, in one pass; columns of these names are replaced."""
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(token, shared.value)
        for b in batches:
            got: list[tuple[str, float]] = []
            part, size = [], 0
            for t in b.column(at):
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size >= AT_ONCE:
                    got += scorer.score(part)
                    part, size = [], 0
            got += scorer.score(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])
        rest()

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the rows that are not held out, then predict every row."""
    return predict(docs, train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), vocabulary, rows))
