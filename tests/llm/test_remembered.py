"""A worker holds one operator's words at a time, and none while it rests."""

import gc
import weakref

import numpy as np
import public_tokenizers

from memweave.llm import bpe, language_id, remembered


def test_the_next_operator_has_the_memory():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = bpe.load(path)
    assert bpe.load(path) is encoder
    gone = weakref.ref(encoder)
    del encoder
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    scorer = language_id._scorer("job", language_id.Model(pieces, ["en"], np.ones((language_id.pieces(pieces).size, 1))))
    gc.collect()
    assert gone() is None
    assert language_id._scorer("job", None) is scorer and language_id._scorer("other job", scorer.model) is not scorer


def test_a_resting_worker_forgets(monkeypatch):
    monkeypatch.setattr(remembered, "IDLE", 0.05)
    first = remembered.remembered("a", lambda: [1])
    remembered.rest()
    assert remembered.remembered("a", lambda: [2]) is first  # a task came in time
    remembered.rest()
    remembered._IDLE[-1].join()
    assert remembered.remembered("a", lambda: [3]) == [3]
    remembered.forget()
