"""Stable ids and tests on terms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for nothing.
PLACEHOLDERS = ["generic", "unknown", "none", "null", "n/a", "na", "unspecified"]
# Fixed value: the form of a generated id.
GENERATED = r"(?i)^(?:(?:entity|rel)_[0-9a-f]{40}|[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})$"


# Fixed value: white space as Unicode has it, what ``(?U)\s`` matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without outer white space of any script. No regular expression, which would try every place of the text."""
    return F.btrim(c, F.lit(SPACES))


def _hashed(prefix: str, *parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(prefix), F.sha1(F.concat(*cols)))


def entity_id(node_type: Column, name: Column) -> Column:
    return _hashed("entity_", node_type, ":", F.lower(strip(name)))


def self_id(user_id: Column) -> Column:
    return _hashed("entity_", "self:", user_id)


def edge_id(subject: Column, predicate: Column, object_: Column) -> Column:
    return _hashed("rel_", subject, ":", predicate, ":", object_)


def document_id(corpus_id: Column, filename: Column) -> Column:
    return _hashed("doc_", "document:", corpus_id, ":", filename)


def corpus_id(name: Column) -> Column:
    return _hashed("corpus_", "corpus:", name)


def is_generated_id(c: Column) -> Column:
    return c.rlike(GENERATED)


def is_placeholder(term: Column, node_type: Column | None = None) -> Column:
    t = F.lower(strip(term))
    hit = t.isin(PLACEHOLDERS)
    return hit if node_type is None else hit | (F.coalesce(node_type, F.lit("")) != "") & (t == F.lower(strip(node_type)))


def is_new_predicate(c: Column) -> Column:
    return F.upper(strip(c)).startswith("NEW:")


def normalized_predicate(c: Column) -> Column:
    """Stripped, without one ``NEW:``, runs of blanks and hyphens as ``_``, in lower case."""
    bare = strip(F.regexp_replace(strip(c), "(?i)^NEW:", ""))
    return F.lower(F.regexp_replace(bare, r"(?U)[\s\-]+", "_"))


def name_key(c: Column) -> Column:
    return F.lower(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def edge_text(subject: Column, predicate: Column, object_: Column) -> Column:
    return strip(F.concat_ws(" ", subject, predicate, object_))
