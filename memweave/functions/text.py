"""Text rules as column expressions: chunking, query modes and parsers of model answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from memweave.functions.ids import strip
from memweave.schema import DEFAULT_TYPE

# Extensions taken as code, and beginnings of questions.
CODE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".cs", ".rb", ".swift", ".kt"]
QUESTION_STARTS = ["who", "what", "when", "where", "why", "how", "which", "whom", "whose", "is ", "are ", "do ", "does ", "did ", "can ", "could ", "should ", "would "]
CHUNK_WORDS, OVERLAP = 600, 1
BULLET = r"^(?U)\s*(?:[-*]\s+|\d+[.)]\s+)"


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def chunk_strategy(filename: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(filename, r"[^/.](\.[^./]+)$", 1)).isin(CODE_EXTENSIONS), F.lit("code")).otherwise(F.lit("prose"))


def chunk_prose(c: Column, words: int = CHUNK_WORDS, overlap: int = OVERLAP) -> Column:
    """Chunks of whole paragraphs of about ``words`` words; the last ``overlap`` (1 or more)
    paragraphs of a chunk open the next. A fold over the paragraphs, as the budget restarts."""
    if overlap < 1:
        raise ValueError("overlap must be at least 1")
    paragraphs = F.filter(F.transform(F.split(c, r"\n\n+"), strip), lambda p: p != "")
    sized = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), word_count(p).alias("n")))
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<p:string,n:int>>").alias("open"), F.lit(0).alias("size")
    )

    def step(s: Column, x: Column) -> Column:
        full = (s["size"] + x["n"] > words) & (F.size(s["open"]) > 0)
        kept = F.when(full, F.slice(s["open"], F.greatest(F.size(s["open"]) - overlap + 1, F.lit(1)), F.lit(overlap))).otherwise(s["open"])
        done = F.when(full, F.concat(s["done"], F.array(_joined(s["open"])))).otherwise(s["done"])
        size = F.when(full, F.aggregate(kept, F.lit(0), lambda t, y: t + y["n"])).otherwise(s["size"])
        return F.struct(done.alias("done"), F.concat(kept, F.array(x)).alias("open"), (size + x["n"]).alias("size"))

    def finish(s: Column) -> Column:
        return F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(_joined(s["open"])))).otherwise(s["done"])

    return F.aggregate(sized, start, step, finish)


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda y: y["p"]), "\n\n")


def is_broad_query(c: Column) -> Column:
    return word_count(F.coalesce(c, F.lit(""))) <= 2


def is_question(c: Column) -> Column:
    q = F.lower(strip(F.coalesce(c, F.lit(""))))
    hit = q.contains("?")
    for s in QUESTION_STARTS:
        hit = hit | q.startswith(s)
    return (q != "") & hit


def delimited(c: Column) -> Column:
    return F.concat(F.lit("<query>"), c, F.lit("</query>"))


def gap_queries(c: Column, most: int = 3) -> Column:
    """Distinct queries of a model's answer, in order."""
    parts = F.transform(F.split(strip(F.coalesce(c, F.lit(""))), r"[\n,;]+"), lambda x: F.regexp_replace(F.regexp_replace(x, BULLET, ""), r"^[ .]+|[ .]+$", ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.upper(x) != "NONE"))), 1, most)


def statements(c: Column, most: int = 3) -> Column:
    """The first lines of an answer, without bullets and numbers."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r]"), strip)
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"^(?U)\s*[-*•]\s*", ""), r"^(?U)\s*\d+\.\s*", "")))
    return F.slice(F.filter(bare, lambda x: x != ""), 1, most)


def gate_name(answer: Column) -> Column:
    """The name that an answer gives on its first line after ``EXISTING:``, else empty."""
    line = strip(F.element_at(F.split(strip(F.coalesce(answer, F.lit(""))), r"\r\n|[\n\r]"), 1))
    return F.lower(strip(F.regexp_extract(line, r"(?i)^EXISTING:(.*)$", 1)))


def gate_answer(answer: Column, known: Column, proposed: Column) -> Column:
    """The known predicate that an answer names on its first line, else the proposed one."""
    name = gate_name(answer)
    return F.when((name != "") & F.array_contains(known, name), name).otherwise(proposed)


def superseded(answer: Column, candidates: Column) -> Column:
    """The candidate id that an answer equals, in whichever case; null without one."""
    return F.get(F.filter(candidates, lambda c: F.lower(c) == F.lower(strip(answer))), F.lit(0))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _lines(c: Column) -> Column:
    one = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.transform(F.split(one, "\n"), strip)  # split by one plain character takes no regular expression


def refinery_status(c: Column) -> Column:
    return _status(_lines(c))


def _status(lines: Column) -> Column:
    found = F.filter(lines, lambda x: F.lower(x).startswith("status:"))
    return _let(found, lambda x: F.when(F.size(x) > 0, F.lower(strip(F.regexp_replace(F.element_at(x, -1), r"^[^:]*:", "")))).otherwise(F.lit("none")))


def refinery_triples(c: Column) -> Column:
    """``array<struct<subject, predicate, object, subject_type, object_type>>`` of an extraction answer."""
    return _let(_lines(c), _triples)


def refinery_facts(c: Column) -> Column:
    """``refinery_triples`` of an answer whose status is not none, else null; its lines are made once."""
    return _let(_lines(c), lambda lines: F.when(_status(lines) != "none", _triples(lines)))


def _triples(lines: Column) -> Column:
    body = _let(F.array_position(F.transform(lines, lambda x: F.lower(x)), "triples:").cast("int"), lambda start: F.when(start > 0, F.slice(lines, start + 1, F.size(lines))).otherwise(F.array().cast("array<string>")))
    body = F.filter(body, lambda x: (x != "") & ~F.lower(x).startswith("status:"))
    parts = F.transform(body, lambda x: F.transform(F.split(x, r"\|"), strip))
    good = F.filter(parts, lambda p: F.size(p).isin(3, 5) & (p[0] != "") & (p[1] != "") & (p[2] != ""))
    kind = lambda p, k: F.when(F.size(p) == 5, F.get(p, F.lit(k))).otherwise(F.lit(DEFAULT_TYPE))
    return F.transform(good, lambda p: F.struct(p[0].alias("subject"), p[1].alias("predicate"), p[2].alias("object"), kind(p, 3).alias("subject_type"), kind(p, 4).alias("object_type")))


def regex_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def mentions(text: Column, name: Column) -> Column:
    """Whether the name stands in the text as whole words, in whichever case."""
    return F.call_function("rlike", text, F.concat(F.lit(r"(?iU)\b"), regex_escaped(name), F.lit(r"\b")))


def source_alias(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")
