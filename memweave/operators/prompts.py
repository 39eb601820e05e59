"""Requests to a language model: what each task says, and how much it may answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a text that a prompt carries.
TEXT_CHARS = 50_000
MAX_TOKENS = {"extract": 4096, "gate": 64, "collide": 16, "supersede": 64, "summary": 1024, "consolidate": 512, "draft": 2048, "thought": 256, "final": 4096}
SYSTEM = {
    "extract": (
        "Read a text and list what it states. First a line 'status: ok', or 'status: none' where it states nothing. Then a line 'triples:' and below it one "
        "fact a line as 'subject | predicate | object | subject type | object type'. Write SELF for the author. Prefer the known predicates; put 'NEW:' before any other."
    ),
    "gate": "Decide whether a proposed predicate says the same as a known one. Answer 'EXISTING: name' for the known one that fits, else 'NEW: approved'.",
    "collide": "Decide whether a new wording renames or corrects a stored one ('update') or is another thing ('insert'). Answer with that one word.",
    "supersede": "Decide which one of a subject's stored facts a new fact replaces. Answer with its id alone, or 'none'.",
    "summary": "Sum up a document in a few plain sentences that name the people, places and things it is about.",
    "consolidate": "Draw up to three lasting facts, habits or changes from these notes. One statement a line, without numbers or bullets.",
}


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def extraction(text: Column, node_types: Column, predicates: Column) -> Column:
    return _lines(F.concat(F.lit("Types: "), node_types), F.concat(F.lit("Known predicates: "), predicates), "", F.substring(text, 1, TEXT_CHARS))


def gate(predicate: Column, subject: Column, object_: Column, predicates: Column) -> Column:
    return _lines(F.concat(F.lit("Proposed: "), predicate), F.concat_ws(" ", F.lit("Used in:"), subject, predicate, object_), F.concat(F.lit("Known: "), predicates))


def collision(new: Column, stored: Column) -> Column:
    return _lines(F.concat(F.lit("New: "), new), F.concat(F.lit("Stored: "), stored))


def supersede(new: Column, facts: Column) -> Column:
    """``facts`` is an array of ``(uuid, content)``."""
    return _lines(F.concat(F.lit("New: "), new), "Stored:", F.array_join(F.transform(facts, lambda f: F.concat(f["uuid"], F.lit(": "), f["content"])), "\n"))


def document_summary(text: Column, filename: Column) -> Column:
    return _lines(F.concat(F.lit("Document: "), filename), "", F.substring(text, 1, TEXT_CHARS))


def consolidation(batch: Column) -> Column:
    return _lines("Notes:", "", batch)


# Summaries of a graph, by the kind of question

SECTIONS = {"question": "Answer, Evidence, Gaps", "broad": "Profile, Work, Relationships, Home, Open items", "free": "Response, Evidence, Gaps"}
MUST = {
    "question": "Answer the question from the graph alone.",
    "broad": "Describe the subject in full from the graph alone; leave out no part of it that the graph shows.",
    "free": "Respond to the request from the graph alone, in short sections.",
}


def delimit(query: str) -> str:
    return f"<query>{query}</query>"


def graph_system(kind: str, query: str) -> str:
    return f"{MUST[kind]} Write Markdown with the sections {SECTIONS[kind]}. No small talk.\n{delimit(query)}"


def thought_system(query: str) -> str:
    return f"Name up to three short searches, one a line, that would fill what this graph lacks for the query, or NONE.\n{delimit(query)}"


def final_user(kind: str, draft: str, graph: str) -> str:
    return f"Improve the draft by the fuller graph. Sections: {SECTIONS[kind]}.\n\nDraft:\n{draft}\n\nGraph:\n{graph}"


def retry_user(kind: str, query: str, graph: str) -> str:
    return f"The answer was too short. Write it anew with every relevant fact. Sections: {SECTIONS[kind]}.\n\n{delimit(query)}\n\nGraph:\n{graph}"
