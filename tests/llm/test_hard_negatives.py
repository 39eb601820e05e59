import math
import random
from collections import defaultdict

import pytest

from memweave.llm import hard_negatives
from memweave.llm.hard_negatives import hard_negatives as mine

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows):
    usable = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    anchors = {}
    for i, label, v in sorted(usable, key=lambda r: (r[1], r[2])):
        if i % 50 == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for i, other, w in usable if i != a)
        for s, p in dict.fromkeys((s, p) for s, p, same in [x for x in scores if x[2]][:5]):
            met = [(-s, -t, i) for t, i, same in scores if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k, i, ps, ns) for k, (ps, ns, i) in enumerate(met, 1)]
    return sorted(out)


def told(spark, rows):
    return sorted(tuple(r) for r in mine(spark.createDataFrame(rows, SCHEMA)).collect())


def vectors(n, seed, size=6):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    return [(k, [rng.gauss(0, 0.6) + x for x in centre[k % 4]], rng.randrange(10), "") for k in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vectors(600, seed)
    got = told(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_ties_of_any_number_go_to_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "DIGIT", 5)
    same = [(k, [0.5, 0.25], 1 if k % 2 else 2, "") for k in range(300)]
    near = [(k, [0.4, 0.2], k % 3, "") for k in range(300, 900)]
    rows = same + near
    got = told(spark, rows)
    assert got == brute(rows) and got


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 1.0], 1, ""), (1, [0.9, 1.0], 2, ""), (2, [1.0], 2, ""), (3, [1.0, float("nan")], 1, ""), (4, [float("inf"), 1.0], 1, ""), (5, None, 1, ""), (6, [1.0, None], 1, ""), (8, [1.0, 0.9], None, ""), (None, [1.0], 1, ""),
        (9, [0.7, 0.7], 3, ""), (10, [0.7, 0.7], 3, ""), (11, [], 3, ""), (12, [0.01, 0.0], 2, ""), (50, [-1.0, -1.0], 1, ""), (100, [0.0, 0.0], 1, ""), (13, [0.7, 0.7], 3, ""), (13, [0.7, 0.7], 3, ""),
    ]
    assert told(spark, rows) == brute(rows)
    assert told(spark, []) == [] == told(spark, [(1, [1.0], 1, "")])


def test_scores_beyond_53_bits_are_exact():
    import numpy as np

    a = np.array([[(1 << 26) - 1, (1 << 26) - 3, 5]], "<i4")
    assert hard_negatives._product(a, a).tolist() == [[((1 << 26) - 1) ** 2 + ((1 << 26) - 3) ** 2 + 25]]
