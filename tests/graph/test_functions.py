import hashlib

import pytest
from pyspark.sql import functions as F

from memweave.functions import code, ids, scoring, text
from memweave.schema import PREDICATES


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def L(x):
    return F.lit(x)


def test_ids(spark):
    assert one(spark, ids.entity_id(L("person"), L("  Ada "))) == "entity_" + hashlib.sha1(b"person:ada").hexdigest()
    assert one(spark, ids.entity_id(L("person"), L("Ada\u00a0"))) == one(spark, ids.entity_id(L("person"), L("ada")))
    assert one(spark, ids.edge_id(L("a"), L("p"), L("b"))) != one(spark, ids.edge_id(L("b"), L("p"), L("a")))
    assert one(spark, ids.self_id(L("u1"))) != one(spark, ids.self_id(L("u2")))
    h = "0123456789abcdef" * 2 + "01234567"
    for s, want in [(f"entity_{h}", True), (f"REL_{h.upper()}", True), ("entity_abc123", False), ("Ada", False), ("123e4567-e89b-12d3-a456-426614174000", True), ("123e4567-e89b-92d3-a456-426614174000", False)]:
        assert one(spark, ids.is_generated_id(L(s))) is want


@pytest.mark.parametrize("raw, want", [("Works At", "works_at"), ("NEW:mentors", "mentors"), ("new:mentors", "mentors"), (" NEW: reports - to ", "reports_to"), ("a\tb", "a_b"), ("NEW:NEW:x", "new:x")])
def test_predicates(spark, raw, want):
    assert one(spark, ids.normalized_predicate(L(raw))) == want


def test_placeholders(spark):
    assert one(spark, ids.is_placeholder(L(" N/A "))) and one(spark, ids.is_placeholder(L("Tool"), L("tool"))) and not one(spark, ids.is_placeholder(L("Ada"), L("person")))


def test_cosine(spark):
    v = lambda *x: scoring.vector(list(x))
    for a, b, want in [((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((0, 0), (1, 0), 0), ((1, 0), (-1, 0), -1), ((1, 2, 3), (1, 2), 5 / (14**0.5 * 5**0.5))]:
        assert one(spark, scoring.cosine(v(*a), v(*b))) == pytest.approx(want)


def test_decay(spark):
    assert [scoring.pool_size(n) for n in (10, 50, 0)] == [50, 200, 1]
    eff = lambda d, age, life, n: one(spark, scoring.effective_distance(L(d), L(age), L(life), L(n)))
    assert eff(0.2, 30.0, 30.0, 0) == pytest.approx(0.4) and eff(0.2, 1.0, 30.0, 0) < 0.4
    assert eff(0.3, 0.0, 365.0, 10) < eff(0.3, 0.0, 365.0, 0) and eff(0.3, 0.0, 1.0, 50) == eff(0.3, 0.0, 1.0, 500)
    assert eff(0.3, 1e9, 1.0, 0) == 0.3  # the divisor underflows
    assert eff(0.3, 10.0, float("inf"), 0) == 0.3
    assert one(spark, scoring.age_days(L(None).cast("timestamp"), L("2024-01-02 00:00:00").cast("timestamp"), "2024-01-04 12:00:00")) == 2.5
    assert one(spark, scoring.age_days(L(None).cast("timestamp"), L(None).cast("timestamp"), "2024-01-04")) == 0


def test_prose_chunks(spark):
    p = [f"{k} " + "w " * 9 for k in range(4)]
    bare = [x.strip() for x in p]
    got = one(spark, text.chunk_prose(L("\n\n".join(p)), 15))
    assert got == [bare[0], *["\n\n".join(bare[k : k + 2]) for k in range(3)]]
    for t, want in [("", []), ("   \n\n \n", []), ("one", ["one"]), ("a b\n\n\n\nc", ["a b\n\nc"]), ("x " * 9 + "\n\ny", ["x " * 8 + "x", "x " * 8 + "x\n\ny"])]:
        assert one(spark, text.chunk_prose(L(t), 7)) == want
    with pytest.raises(ValueError):
        text.chunk_prose(L("x"), overlap=0)
    for name, want in [("a.py", "code"), ("b/C.TSX", "code"), ("n.md", "prose"), (".py", "prose"), ("x", "prose")]:
        assert one(spark, text.chunk_strategy(L(name))) == want


def test_code_chunks(spark):
    src = "import os\nX = 1\n\ndef f():\n    pass\n\nasync def g():\n    pass\nclass A:\n    def m(self): ...\n"
    cut = lambda t, n=600: one(spark, code.chunk_code(L(t), n))
    assert cut(src) == ["import os\nX = 1\n\ndef f():\n    pass", "async def g():\n    pass", "class A:\n    def m(self): ..."]
    assert cut("x = 1\n\ny = 2") == ["x = 1\n\ny = 2"] and cut("") == [] and cut("def f(): ...") == ["def f(): ..."]
    assert cut("a\r\ndef f(): ...\x0cclass B: ...") == ["a\n\ndef f(): ...", "class B: ..."]
    assert cut("def f():\n" + "\n\n".join("  a b c" for _ in range(4)), 4) == ["def f():\n  a b c", "a b c", "a b c\n\na b c"] or len(cut("def f():\n" + "\n\n".join("  a b c" for _ in range(9)), 4)) > 1
    assert one(spark, code.chunk_code(F.lit(None).cast("string"))) is None


def test_structure(spark):
    s = lambda t, f: [tuple(x) for x in one(spark, code.structural_triples(L(t), L(f)))]
    assert s("import os.path\nfrom a.b import c\nfrom . import d\nclass K:\n  import no\n  def m(self): ...\n  async def n(self): ...\n  class I:\n    def deep(self): ...\nif 1:\n  def hidden(): ...\ndef f(): ...", "p/mod.py") == [
        ("mod", "imports", "os"), ("mod", "imports", "a"), ("mod", "defines", "K"), ("K", "has_method", "m"), ("K", "has_method", "n"), ("mod", "defines", "f"),
    ]
    assert s("def (:\nimport re\nimport re", "x.py") == [("x", "imports", "re")]
    assert s("const a = require('lib/x'); import b from \"react\"", "y.js") == [("y", "imports", "lib"), ("y", "imports", "b"), ("y", "imports", "react")]
    assert s("import os", "n.txt") == []


def test_parsers(spark):
    a = "Status: OK\nnoise | a | b\nTRIPLES:\n Ada | Works At | Lab | person | org \nbad | line\nAda||x\n\nAda | NEW:met | Bob"
    assert one(spark, text.refinery_status(L(a))) == "ok" and one(spark, text.refinery_status(L("x"))) == "none"
    got = [tuple(t) for t in one(spark, text.refinery_triples(L(a)))]
    assert got == [("Ada", "Works At", "Lab", "person", "org"), ("Ada", "NEW:met", "Bob", "generic", "generic")]
    assert one(spark, text.refinery_triples(L("a|b|c"))) == []
    known = F.array(*map(F.lit, PREDICATES))
    for answer, want in [("EXISTING: knows", "knows"), ("existing: KNOWS\nmore", "knows"), ("EXISTING: odd", "p"), ("EXISTING:", "p"), ("", "p"), ("NEW: ok", "p")]:
        assert one(spark, text.gate_answer(L(answer), known, L("p"))) == want
    c = F.array(L("rel_ab"), L("rel_abc"))
    for answer, want in [(" REL_AB ", "rel_ab"), ("rel_abcd", None), ("the rel_ab", None), ("NONE", None)]:
        assert one(spark, text.superseded(L(answer), c)) == want
    assert one(spark, text.gap_queries(L("1. a\n- b, a; NONE.\nc.\nd"))) == ["a", "b", "c"] and one(spark, text.gap_queries(L("none"))) == []
    assert one(spark, text.statements(L("- 1. a\n\n• b\n c\nd"))) == ["a", "b", "c"]


def test_query_modes(spark):
    for q, broad, question in [("Who?", True, True), ("however it goes on", False, True), ("tell me of Ada", False, False), ("", True, False), ("is it so now", False, True), ("island of gold here", False, False)]:
        assert (one(spark, text.is_broad_query(L(q))), one(spark, text.is_question(L(q)))) == (broad, question)


def test_mentions(spark):
    for t, name, want in [("I use C++ daily", "C++", False), ("met ADA here", "Ada", True), ("adamant", "Ada", False), ("a.b x", "a.b", True), ("axb", "a.b", False), ("Zoë!", "zoë", True)]:
        assert one(spark, text.mentions(L(t), L(name))) is want


def test_strip_is_what_the_regular_expression_took(spark):
    odd = [chr(c) for c in [*range(0x0, 0x500), *range(0x1680, 0x1700), *range(0x1800, 0x1810), *range(0x2000, 0x2100), 0x3000, 0xFEFF, 0x1F600]]
    rows = [(f"{c}a{c}b{c}",) for c in odd] + [(f"{c}{c}",) for c in odd] + [("",), (" \t　\n",), ("a \r\n ",), (None,)]
    told = spark.createDataFrame(rows, "s string").select("s", ids.strip(F.col("s")).alias("got"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("want"))
    assert told.where("NOT (got <=> want)").count() == 0


def test_an_answer_is_split_once(spark):
    said = spark.createDataFrame([("status: ok\r\ntriples:\r a | b | c \nstatus: None ",), (None,), ("x",)], "said string")
    told = said.select(text.refinery_triples(F.col("said")).alias("t"), text.refinery_status(F.col("said")).alias("s"))
    plan = told._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 3 and "(?U)^" not in plan
    assert [(r["t"] and [tuple(t)[:3] for t in r["t"]], r["s"]) for r in told.collect()] == [([("a", "b", "c")], "none"), ([], "none"), ([], "none")]
