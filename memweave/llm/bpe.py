"""Byte-level BPE encoding and decoding by a pair occurrence index.

Each task gathers the distinct pieces of a batch that it has not met yet, lays their
symbols in one array, and maps every mergeable pair to all its positions there. The
active ranks are applied in ascending order; a merge at a position takes the two
neighbouring pairs out and enters the new ones in their lists.

Defined results: a null text is the empty text, with no ids; the added token's string
in a text is that token; whole texts are encoded. Ids outside the vocabulary raise
``ValueError`` on decoding. Nothing is shuffled; memory is bounded by the batch and by
``CACHE`` remembered pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memweave.llm.remembered import remembered, rest

CACHE = 300_000
#: Unicode white space, as the pattern's \s means it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for c, b in [*((b, b) for b in shown), *((256 + k, b) for k, b in enumerate(hidden))]}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        vocab = spec["model"]["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(letter[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: s.encode() for s, i in self.added.items()}
        self.single = np.zeros(256, np.int64)
        for i, s in self.pieces.items():
            if len(s) == 1:
                self.single[s[0]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = [vocab[a] for a, _ in merges]
        self.right = [vocab[b] for _, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            self.rank.setdefault(a << 20 | b, r)
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {s: array("I", [i]).tobytes() for s, i in self.added.items()}
        self.fixed = len(self.known)
        self.spaced: dict[str, bytes] = {}  # a space and a word

    def pieces_of(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.added):
            return self.words.findall(text)
        return [p for k, part in enumerate(self.split.split(text)) for p in ([part] if k % 2 else self.words.findall(part))]

    def learn(self, words: list[str]) -> None:
        """Encode pieces together through the pair occurrence index, and remember their ids."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        ends = np.cumsum(sizes + 1)  # each piece is followed by a gap
        flat = np.full(int(ends[-1]), -1, np.int64)
        spots = np.ones(len(flat), bool)
        spots[ends - 1] = False
        flat[spots] = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        key = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << 20 | flat[1:], -1)
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[where] == key)
        rank = self.ranks[where[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        index: dict[int, list[int]] = {int(rank[c]): p.tolist() for c, p in zip(cuts, np.split(at, cuts[1:]), strict=True)} if len(at) else {}
        n = len(flat)
        sym, after, before = array("q", flat.tobytes() + b"\xff" * 8), array("q", range(1, n + 2)), array("q", range(-1, n))
        view = [np.frombuffer(x, np.int64) for x in (sym, after, before)]  # the same memory, for long lists
        active = list(index)
        heapq.heapify(active)
        rank_of, left, right, made = self.rank.get, self.left, self.right, self.made

        def enter(k: int, spots: list[int]) -> None:
            if k in index:
                index[k] += spots
            else:
                index[k] = spots
                heapq.heappush(active, k)

        while active:
            r = heapq.heappop(active)
            a, b, ab = left[r], right[r], made[r]
            spots_of = index.pop(r)
            if len(spots_of) > 16 and a != b:
                for k, spots in self._merge(view, np.array(spots_of, np.int64), a, b, ab):
                    enter(k, spots)
                continue
            spots_of.sort()
            for p in spots_of:
                if sym[p] != a:
                    continue
                q = after[p]
                if sym[q] != b:
                    continue
                sym[p], sym[q] = ab, -2
                after[p] = s = after[q]
                before[s] = p
                if (x := sym[s]) >= 0 and (k := rank_of(ab << 20 | x)) is not None:
                    enter(k, [p])
                o = before[p]
                if o >= 0 and (x := sym[o]) >= 0 and (k := rank_of(x << 20 | ab)) is not None:
                    enter(k, [o])
        del view
        ids = np.frombuffer(sym, np.int64)[:n]
        keep = ids >= 0
        upto = np.cumsum(keep)[ends - 1].tolist()
        data = ids[keep].astype("<u4").tobytes()
        start = 0
        for w, end in zip(words, upto, strict=True):
            self.known[w] = data[4 * start : 4 * end]
            start = end

    def _merge(self, view: list[np.ndarray], p: np.ndarray, a: int, b: int, ab: int) -> Iterator[tuple[int, list[int]]]:
        """Merge a pair at all its positions; the ranks and positions of the pairs that this makes."""
        sym, after, before = view
        p = p[sym[p] == a]
        q = after[p]
        fits = sym[q] == b
        p, q = p[fits], q[fits]
        if not len(p):
            return
        sym[p], sym[q] = ab, -2
        s = after[q]
        after[p], before[s] = s, p
        o = before[p]
        x, y = sym[s], np.where(o >= 0, sym[o], -1)
        key = np.concatenate([ab << 20 | x[x >= 0], y[y >= 0] << 20 | ab])
        at = np.concatenate([p[x >= 0], o[y >= 0]])
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        real = self.keys[where] == key
        rank, at = self.ranks[where[real]], at[real]
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order].tolist()
        cuts = [*np.flatnonzero(np.diff(rank, prepend=-1)).tolist(), len(rank)]
        for c, d in zip(cuts, cuts[1:]):
            yield int(rank[c]), at[c:d]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        No piece spans the place before a space that follows something else, so a text
        with single spaces is cut there first, and only words not met yet meet the pattern.
        """
        if len(self.known) > CACHE:
            self.known = dict(list(self.known.items())[: self.fixed])
        if len(self.spaced) > CACHE:
            self.spaced = {}
        whole: dict[int, list[str]] = {}  # by the pattern alone
        heads: dict[int, list[str]] = {}
        parts: list[list[str]] = []
        for k, t in enumerate(texts):
            if "  " in t or any(s in t for s in self.added):
                whole[k] = self.pieces_of(t)
                parts.append([])
                continue
            first, *rest = t.split(" ")
            heads[k] = self.words.findall(first)
            parts.append(rest)
        words = {w: self.words.findall(" " + w) for w in set().union(*parts).difference(self.spaced)}
        new = list(set().union(*whole.values(), *heads.values(), *words.values()).difference(self.known))
        if new:
            self.learn(new)
        ids, spaced = self.known.__getitem__, self.spaced
        for w, pieces in words.items():
            spaced[w] = b"".join(map(ids, pieces))
        get = spaced.__getitem__
        return [b"".join(map(ids, whole[k])) if k in whole else b"".join(map(ids, heads[k])) + b"".join(map(get, rest)) for k, rest in enumerate(parts)]

    def decode(self, ids: bytes) -> str:
        try:
            return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        except KeyError as e:
            raise ValueError(f"unknown id {e}") from e


def load(path: str) -> ByteBPE:
    """One encoder for each worker process and vocabulary file, while its tasks come."""
    return remembered(("bpe", path), lambda: ByteBPE(path))


def groups(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in groups of about ``most`` characters."""
    for b in batches:
        keys, texts, size = [], [], 0
        for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py() or ""
            keys.append(k)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def encode(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for keys, texts in groups(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(texts)]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        rest()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids; a null list is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
        rest()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass and return digests of both, so that no ids are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for keys, texts in groups(batches):
            ids = bpe.encode_batch(texts)
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(bpe.decode(x).encode()) for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        rest()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
