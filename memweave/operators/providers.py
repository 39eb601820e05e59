"""Embedding and language-model providers as Arrow-batched functions.

An embedder takes texts and a task, a model takes requests; both are made once for each
Python worker by the factory that is passed in. The two here need no network and always
give the same answer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_CHARS = 10_000
#: Tasks of an embedder: what is stored, and what is asked.
DOCUMENT_TASK, QUERY_TASK = "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"
MAX_TOKENS = 1024
#: Of a document, for the stand-in's summary.
SUMMARY_CHARS = 600
#: Calls at once that a hosted model may allow; the providers here have no such limit.
HOSTED_CALLS = 3


class Request(NamedTuple):
    system: str
    user: str
    max_tokens: int = MAX_TOKENS


Embedder = Callable[[list[str], str], list]
Model = Callable[[list[Request]], list[str]]


def hashed_words(size: int = 64) -> Embedder:
    """Unit vectors of hashed words: texts that share words are near, whatever the task."""

    def run(texts: list[str], task: str = DOCUMENT_TASK) -> list:
        out = np.zeros((len(texts), size), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                row[h % size] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out.tolist()

    return run


def rules() -> Model:
    """Extraction by one pattern: ``<name> <verb phrase> <name>.`` with capitalised names. A summary is a document's beginning."""
    fact = re.compile(r"\b([A-Z]\w*)\s+((?:[a-z]+\s+){1,3})(?:the\s+|a\s+)?([A-Z]\w*)")

    def run(requests: list[Request]) -> list:
        out = []
        for r in requests:
            p = r.user
            if p.startswith("Document: "):
                out.append(p.split("\n\n", 1)[1].strip()[:SUMMARY_CHARS])
                continue
            found = [f"{a} | {'_'.join(v.split())} | {b}" for a, v, b in fact.findall(p)]
            out.append("\n".join(["status: ok", "triples:", *found]) if found else "status: none")
        return out

    return run


def with_retry(make: Callable, times: int = 2) -> Callable:
    """The provider again after a timeout, as often as ``times`` in all."""

    def made() -> Callable:
        inner = make()

        def run(*args):
            for left in reversed(range(times)):
                try:
                    return inner(*args)
                except TimeoutError:
                    if not left:
                        raise
            raise AssertionError

        return run

    return made


def embed(c: Column, make: Callable[[], Embedder] = hashed_words, task: str = DOCUMENT_TASK) -> Column:
    held: dict = {}

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        if "p" not in held:
            held["p"] = make()
        return pd.Series(held["p"](s.fillna("").tolist(), task))

    return run(F.substring(c, 1, EMBED_CHARS))


def _answered(model: Model, requests: list[Request]) -> list[tuple[str | None, str | None]]:
    """Answers and errors; where a call for many fails, each is asked by itself, so one failure stays one."""
    try:
        return [(a, None) for a in model(requests)]
    except Exception as e:
        if len(requests) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [x for r in requests for x in _answered(model, [r])]


def ask(df: DataFrame, prompt: Column, name: str, make: Callable[[], Model] = rules, system: str = "", max_tokens: int = MAX_TOKENS, parallel: int | None = None) -> DataFrame:
    """``df`` with a model's answer, and with ``{name}_error`` where a call failed.

    Calls run in all tasks at once; ``parallel`` bounds them, for a hosted model.
    """
    held: dict = {}

    @F.pandas_udf("answer string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        if "p" not in held:
            held["p"] = make()
        return pd.DataFrame(_answered(held["p"], [Request(system, x, max_tokens) for x in s.fillna("")]), columns=["answer", "error"])

    at = (df.repartition(parallel) if parallel else df).withColumn("__said", run(prompt))
    return at.select(*df.columns, F.col("__said.answer").alias(name), F.col("__said.error").alias(f"{name}_error"))
