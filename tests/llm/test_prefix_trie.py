import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from memweave.llm import prefix_trie
from memweave.llm.prefix_trie import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, under = defaultdict(list), defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
        for d in range(len(p) + 1):
            under[p[:d]].append(p)
    out = []
    for p, cs in members.items():
        leaves = sum(not children[q] for q in under[p])
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under[p] if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves, saved, digest))
    return sorted(out, key=str)


def told(spark, rows):
    got = trie(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in got.collect()), key=str)


def random_rows(seed, most=9):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(705, 720)]:
        shape = rng.choice(["short", "copy", "empty"])
        for t in range(1 if shape == "empty" else rng.randint(1, most)):
            role = rng.choice(["user", "assistant", None]) if shape == "short" else "user"
            text = rng.choice(["a", "é😀", None, "", "long " * 9]) if shape == "short" else f"t{t}"
            rows.append((c, t or None, role, text, "x"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    rows = random_rows(seed)
    assert told(spark, rows) == brute(rows)


def test_stretches_equal_single_levels(spark, monkeypatch):
    """Deep shared prefixes go through stretches of several levels, with branches inside them."""
    monkeypatch.setattr(prefix_trie, "SINGLY", 1)
    monkeypatch.setattr(prefix_trie, "WIDEST", 8)
    rows = []
    for c in range(200, 212):
        for t in range(45):
            rows.append((c, t, "user", "other" if t == 3 * c - 580 else f"same {t}", ""))
    rows += [(300 + c, t, "user", f"same {t}", "") for c in range(3) for t in range(40 + c // 2)]
    rows += random_rows(3)
    assert told(spark, rows) == brute(rows)


def test_edge_cases(spark):
    assert told(spark, []) == []
    alone = [(7, 0, None, None, "")]
    assert told(spark, alone) == brute(alone)
    # a turnless conversation is a member of the root; rows without an id take no part; repeated rows are turns
    rows = [(101, 0, "user", "x", ""), (None, 0, "user", "x", ""), (5, None, "user", "b", ""), (5, 1, "user", "a", ""), (5, 1, "user", "a", ""), (0, 1, "user:", "1", ""), (0, 2, "user", ":1", "")]
    assert told(spark, rows) == brute([r for r in rows if r[0] is not None])


def test_ends_of_a_hot_node_come_in_parts(spark):
    ends = spark.range(5000).selectExpr("1L AS depth", "0L AS node", "id * 7 AS member")
    got = prefix_trie.ends_digest(ends).collect()
    assert [(r.depth, r.conv_id, r.ends_sha256) for r in got] == [(1, 0, hashlib.sha256(",".join(str(7 * k) for k in range(5000)).encode()).hexdigest())]
