import hashlib
import random
import re

from memweave.llm import minhash
from memweave.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünder", "É", "A", "a", "x\x1fy", "p\x0bq"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.75:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 30, 80, 200]))]
        texts.append(" ".join(t))
    return texts


def test_against_brute_force(spark):
    for seed, k in ((1, 4), (2, 5)):
        texts = [*corpus(seed), "", None, "   \t", "", "One two", "one  TWO", "y " * 30_000]
        ids = random.Random(seed).sample(range(1000), len(texts))
        rows = [*zip(ids, texts), (None, texts[0]), (None, ""), (ids[3], texts[3])]
        df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int")
        got = sorted((tuple(r) for r in minhash.near_duplicates(df, k).collect()), key=str)
        assert got == brute(rows, k)


def test_a_chain_whose_ends_differ_and_many_copies(spark):
    base = [f"t{i}" for i in range(120)]
    rows = []
    for step in range(25):  # each links with the next alone
        text = base.copy()
        for j in range(step):
            text[j * 4] = f"n{j}"
        rows.append((100 - step, " ".join(text)))
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, 4).collect()), key=str)
    assert got == brute(rows, 4)
    assert len({r[2] for r in got}) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).collect() == []


def test_components(spark):
    rng = random.Random(5)
    for links in ([], [(1, 1)], [(1, 2), (2, 1), (2, 3), (None, 3)], [(i, i + 1) for i in range(40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], [(0, i) for i in range(1, 50)]):
        root = {x: x for l in links if None not in l for x in l}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            if a is not None and b is not None:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        want = {x: find(x) for a, b in links if None not in (a, b) and a != b for x in (a, b)}
        got = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_long_words_with_equal_polynomials_stay_apart(spark):
    """Two words of 1,024 letters that any polynomial modulo 2^64 confuses."""
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=4).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_one_row_of_each_group_stays(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base + " more"
    rows = [(5, base, "a"), (5, base, "a"), (5, near, "b"), (7, near, "c"), (None, base, "d"), (None, "alone here", "e"), (8, None, "f"), (8, None, "f"), (9, " ", "g"), (10, "other words", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.digest) for r in minhash.remove_near_duplicates(df).collect()), key=str)
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    first = "a" if digest(base) < digest(near) else "b"
    assert got == sorted([(5, first), (None, "e"), (8, "f"), (8, "f"), (9, "g"), (10, "h")], key=str)
    assert minhash.remove_near_duplicates(df.limit(0)).count() == 0


def test_groups_that_meet_by_few_pairs(spark):
    """Many near copies on both sides share frequent shingles; few pairs across are similar."""
    shared = [f"s{k}" for k in range(100)]
    left = [shared + [f"l{k}" for k in range(j, j + 24)] for j in range(0, 12, 2)]
    right = [shared + [f"l{k}" for k in range(10)] + [f"r{k}" for k in range(j, j + 12)] for j in range(6)]
    rows = [(n, " ".join(w)) for n, w in enumerate(left + right + [x[:70] + ["cut"] + x[70:] for x in left])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4)


def confused():
    """Two words of 700 printable bytes with one unkeyed XXH3, of 64 and of 128 bits."""
    import xxhash

    a = bytearray(b"a" * 700)
    a[196:200], a[324:328] = b"_!a_", b"$mta"
    b = bytearray(a)
    a[192], a[320], b[192], b[320] = *b"bc", *b"cb"
    assert xxhash.xxh3_128_digest(bytes(a)) == xxhash.xxh3_128_digest(bytes(b)) and a != b
    return a.decode(), b.decode()


def test_words_that_a_fast_hash_confuses(spark):
    rows = [(k, x) for k, x in enumerate(confused())]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(0, 0, True), (1, 1, True)]
