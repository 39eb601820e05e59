from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from memweave.llm import language_id, line_dedup, packing, pipeline
from tests.llm.test_minhash import brute as near_brute

WORDS = {"en": "the house is very old and the dog sleeps there all day long".split(), "de": "das Haus ist sehr alt und der Hund schläft dort den ganzen Tag".split()}
ORDER = lambda i: (i is None, i or 0)


def documents():
    """Prose in two languages, junk, shared blocks, near copies, a shared passage."""
    rows = []
    header = "A header line that a number of the documents have in common, word for word."
    passage = " ".join(f"passage{i}" for i in range(60))
    for i in range(60):
        lang = "en" if i % 3 else "de"
        own = [WORDS[lang][(i * 7 + k * (i % 5 + 1)) % 13] + (f"{i}x{k}" if k % 4 == 0 else "") for k in range(80)]
        lines = [" ".join(own[k : k + 10]) for k in range(0, 80, 10)]
        if i % 4 == 0:
            lines.insert(0, header)
        if i % 10 == 3:
            lines.insert(3, f"start {i} " + passage + f" end {i}")
        rows.append((i, "\n".join(lines), lang))
    line = [WORDS["en"][k % 13] + str(k) for k in range(200)]
    rows += [(300 + k, " ".join(line[:50] + [f"edit{k}"] + line[51:]), "en") for k in range(3)]
    rows += [(100 + k, rows[7][1].replace("day", "night", k), "en") for k in range(4)] + [(200, None, "en"), (201, "12 34 !!", "en"), (202, "", None), (203, "the dog", "en")]
    rows += [(None, "no id for this one", "en")]
    return rows


def without_lines(rows):
    lines = {i: t.split("\n") for i, t in rows}
    holders = {}
    for i in sorted(lines, key=ORDER):
        for x in {x for x in lines[i] if x.strip()}:
            holders.setdefault(x, []).append(i)
    gone = {i: set() for i in lines}
    for h in holders.values():
        for a in h:
            for b in h:
                if ORDER(a) < ORDER(b):
                    gone[b] |= set(line_dedup.common_blocks(lines[a], lines[b], [len(x.strip()) for x in lines[b]], line_dedup.MIN_CHARS))
    return [(i, "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i])) for i in sorted(lines, key=ORDER)]


def without_repeats(rows, window=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: ORDER(r[0])):
        raw = t.encode()
        cut = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            if s in seen:
                cut[p : p + window] = b"\1" * window
            seen.add(s)
        out.append((i, bytes(b for b, c in zip(raw, cut) if not c).decode("utf-8", "ignore")))
    return out


def test_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.piece, tuple(r.input_ids[: r.n_tokens])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = [(i, t) for i, t, _ in rows if t and language_id.LETTER.search(t)]
    assert {i for i, _, _ in rows} - {i for i, _ in kept} == {200, 201, 202}
    kept = without_lines(kept)
    stay = {None} | {d for d, _, _, keep in near_brute(kept, 5) if keep}
    assert len(stay) < len(kept)
    kept = without_repeats([r for r in kept if r[0] in stay])
    want = Counter()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in kept:
        ids = encoder.encode(t, add_special_tokens=False).ids
        want.update((i, k, tuple(ids[k * packing.MAX_LEN : (k + 1) * packing.MAX_LEN])) for k in range(max(1, -(-len(ids) // packing.MAX_LEN))))
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in documents()], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

