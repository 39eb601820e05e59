"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Lexicon: word beginnings that stand far more often in toxic than in other labelled
   texts. Each entry is a voter that says "toxic" or abstains; so are a few patterns.
2. Label model: the voters' rates under a hidden label, by expectation maximisation over
   the votes. Labels choose the voters and give their rates a start and a prior of
   ``PRIOR`` times the sample's weight (without it the model drifts to another split of the
   rows); what is labelled is no vote on its row, so a posterior rests on the row's votes
   alone. An abstention says nothing by itself; that all voters abstain is a vote for
   "not toxic". Voters that agree beyond what the label explains are correlated; a voter
   counts by one over the sum of its correlations, so nested word beginnings do not count
   twice.
3. A logistic regression on the voters and further entries is trained on the posterior
   labels, and scores whole texts.

Fitting reads about ``TRAIN_ROWS`` labelled rows, chosen by hash: the bound on the
fitting sample, so votes and features of it may be gathered on the driver. Scoring
reads every row, and nothing but its text.

Defined results: a null or empty text has no votes and gets the classifier's base
score. A doc_id with several labels is toxic if one says so; null labels and doc_ids
teach nothing; a null doc_id is not held out. Without any usable toxic and other row
every score is 0.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memweave.llm.bpe import groups
from memweave.llm.language_id import held_out
from memweave.runtime import materialize, release

TRAIN_ROWS = 16_000
STEM = range(3, 9)
VOTERS, ENTRIES = 160, 640
#: An entry stands in so many toxic texts, and in this share of them, at least.
LEAST_ROWS, LEAST_SHARE, LEAST_RATIO = 4, 0.015, 12.0
#: Texts that share so much of their words are near copies when words are mined.
COPY_SHARE = 0.8
PRIOR, LEAST_CORRELATION = 0.3, 0.3
CACHE = 400_000
EDGE = re.compile(r"^\W+|\W+$")
PATTERNS = ("shouting", "marks", "masked", "ratio")


def stems(word: str) -> list[str]:
    """Beginnings of a word, and the word itself with its end marked."""
    w = EDGE.sub("", word)
    return [w[:n] for n in STEM if n <= len(w)] + ([w + "$"] if w else [])


def pattern_votes(text: str) -> list[int]:
    words = text.split()
    caps = sum(w.isupper() and len(w) > 2 for w in words)
    return [
        int(caps > 0.3 * len(words) > 0),
        int(text.count("!") > 0.05 * max(len(words), 1) and "!!" in text),
        int(bool(re.search(r"\b\w[*#@$]{2,}\w?", text))),
        int(bool(words) and len(set(words)) < 0.2 * len(words)),
    ]


@dataclass
class Model:
    entries: dict[str, int]  # lexicon entry to feature number
    weights: np.ndarray  # one a feature: entries, then patterns
    bias: float
    voters: np.ndarray | None = None  # features that vote
    label_model: LabelModel | None = None


class Finder:
    """Feature numbers of the entries in a text, with remembered words."""

    def __init__(self, entries: dict[str, int]):
        self.entries = entries
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        if len(self.known) > CACHE:
            self.known = {}
        known, out = self.known, set()
        for w in set(text.lower().split()):
            got = known.get(w)
            if got is None:
                got = known[w] = tuple({self.entries[s] for s in stems(w) if s in self.entries})
            if got:
                out.update(got)
        return out


def _stem_counts(sample: DataFrame) -> DataFrame:
    """``(stem, toxic, other)``: in how many texts of each label a stem stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        names = ["stem", "toxic", "other"]

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(counts, pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=names)

        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for s in {s for w in set(text.as_py().lower().split()) for s in stems(w)}:
                    counts.setdefault(s, [0, 0])[0 if label else 1] += 1
                if len(counts) > 500_000:
                    yield out()
                    counts = {}
        yield out()

    return sample.mapInArrow(run, "stem string, toxic long, other long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _words(text: str) -> set[str]:
    return set(text.lower().split())


def _unlike(sample: DataFrame) -> DataFrame:
    """The sample without near copies, which would make words of chance entries.

    Rows of one label that share their two smallest word hashes are compared: in the order
    of their digests, a text goes if it shares ``COPY_SHARE`` of its words with one that
    stays. The sample's bound is the bound of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = ["".join(sorted(hashlib.blake2b(w.encode(), digest_size=8).hexdigest() for w in _words(t.as_py()))[:2]) for t in b.column(1)]
            yield pa.record_batch([*b.columns, pa.array(keys, pa.string())], names=["toxic", "text", "key"])

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[set[str]] = []
        stay = []
        for at in sorted(range(len(rows)), key=lambda k: hashlib.sha256(rows["text"].iloc[k].encode()).digest()):
            own = _words(rows["text"].iloc[at])
            if not any(len(own & x) >= COPY_SHARE * len(own | x) for x in kept):
                kept.append(own)
                stay.append(at)
        return rows.iloc[stay][["toxic", "text"]]

    return sample.mapInArrow(run, "toxic int, text string, key string").groupBy("toxic", "key").applyInPandas(thin, "toxic int, text string")


def _best_stems(found: list[tuple[str, int, int]]) -> list[str]:
    """Of a stem and its longer forms, those that add to what the other finds."""
    counts = {s: (t, o) for s, t, o in found}
    kept = []
    for s, t, o in found:
        longer = any(e != s and e.startswith(s) and counts[e][0] >= 0.8 * t and counts[e][1] < o for e in counts)
        shorter = any((a := counts.get(s.rstrip("$")[:n])) and s != s[:n] and a[0] >= t and a[1] <= o for n in STEM if n < len(s))
        if not longer and not shorter:
            kept.append(s)
    return kept


def _votes(sample: DataFrame, entries: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Labels and 0/1 features of the bounded sample."""
    size = len(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(entries)
        for b in batches:
            rows = [sorted(find(t.as_py())) + [size + k for k, v in enumerate(pattern_votes(t.as_py())) if v] for t in b.column(1)]
            yield pa.record_batch([b.column(0).cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "found"])

    got = sample.mapInArrow(run, "toxic int, found array<int>").toArrow()
    x = np.zeros((len(got), size + len(PATTERNS)), np.float32)
    for k, row in enumerate(got.column("found").to_pylist()):
        x[k, row] = 1
    return got.column("toxic").to_numpy().astype(np.float64), x


@dataclass
class LabelModel:
    """``rates`` has P(vote | label) of each voter, the last of them "all abstain"."""

    prior: float
    rates: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of 0/1 ``votes``."""
        logit = np.log(self.prior / (1 - self.prior)) + _with_silence(votes) @ (np.log(self.rates[:, 1] / self.rates[:, 0]) / self.correlations.sum(1))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _with_silence(votes: np.ndarray) -> np.ndarray:
    return np.concatenate([votes, votes.sum(1, keepdims=True) == 0], 1).astype(np.float64)


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40, share: float = PRIOR) -> LabelModel:
    """Rates and correlations by expectation maximisation over 0/1 ``votes`` for abstain/toxic.

    ``labels`` are met only as sums: their mean is the class balance, and the rates that each
    voter has on the rows labelled so are its start and prior.
    """
    seen = _with_silence(votes)
    n, voters = seen.shape
    given = np.stack([((labels == y) @ seen + 0.5) / ((labels == y).sum() + 1) for y in (0, 1)], 1)
    model = LabelModel(float(np.clip(labels.mean(), 0.005, 0.5)), np.clip(given, 1e-4, 1 - 1e-4), np.eye(voters))
    weight = share * n
    for turn in range(rounds):
        post = model.posterior(votes)
        for y, w in ((0, 1 - post), (1, post)):
            model.rates[:, y] = (w @ seen + weight * given[:, y] + 0.01) / (w.sum() + weight + 0.02)
        model.rates = np.clip(model.rates, 1e-4, 1 - 1e-4)
        if turn % 5 == 0:
            rest = seen - (1 - post)[:, None] * model.rates[:, 0] - post[:, None] * model.rates[:, 1]
            spread = np.sqrt((rest**2).mean(0)) + 1e-6
            corr = np.clip((rest.T @ rest / n) / np.outer(spread, spread), 0, 1)
            corr[corr < LEAST_CORRELATION] = 0
            np.fill_diagonal(corr, 1)
            model.correlations = corr
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``, less the held-out rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, rows / max(total, 1)) * 1_000_003)
    usable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    sample = materialize(chosen.join(usable, "doc_id").select("toxic", "text"), "labelled")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return None
    unlike = materialize(_unlike(sample), "unlike")
    size = {r["toxic"]: r["count"] for r in unlike.groupBy("toxic").count().collect()}
    n1, n0 = size[1], size[0]
    ratio = ((F.col("toxic") + 0.5) / n1) / ((F.col("other") + 0.5) / n0)
    lexicon = (
        _stem_counts(unlike)
        .where(F.col("toxic") >= max(LEAST_SHARE * n1, min(LEAST_ROWS, n1 / 10)))
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc(F.col("toxic") * F.log("ratio")), F.length("stem"), "stem")
        .limit(4 * ENTRIES)  # the size of the model, not of the data
        .select("stem", "toxic", "other")
        .collect()
    )
    release(unlike)
    entries = {s: k for k, s in enumerate(_best_stems([tuple(r) for r in lexicon])[:ENTRIES])}
    y, x = _votes(sample, entries)
    release(sample)
    voters = np.r_[0 : min(VOTERS, len(entries)), len(entries) : x.shape[1]]
    votes = x[:, voters].astype(np.float64)
    labels_of = fit_label_model(votes, y)
    weights, bias = fit_linear(x, labels_of.posterior(votes))
    return Model(entries, weights, bias, voters, labels_of)


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row. No shuffle."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return narrow.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        find, size = Finder(m.entries), len(m.entries)
        for keys, texts in groups(batches):
            out = []
            for t in texts:
                z = m.bias + sum(m.weights[k] for k in sorted(find(t))) + sum(m.weights[size + k] for k, v in enumerate(pattern_votes(t)) if v)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labelled rows that are not held out, then score every row."""
    return score(docs, train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, rows))
