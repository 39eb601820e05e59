"""Source code as column expressions: chunks at top-level definitions, and structural triples.

Only the outline of Python files, which needs their syntax tree, goes through a Python function.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from memweave.functions.ids import strip
from memweave.functions.text import CHUNK_WORDS, chunk_prose, chunk_strategy, word_count

# What starts a top-level definition, what names an import in any language, and where lines end.
DEFINITION = r"(?:def |class |async def )"
IMPORT = r"""(?:import|require|from)\s*\(?['"]?([a-zA-Z0-9_/@.-]+)['"]?"""
LINE_ENDS = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
PREDICATE_OF = {"import": "imports", "definition": "defines", "method": "has_method"}
OUTLINE = "array<struct<owner:string,kind:string,name:string>>"


def chunk_code(c: Column, words: int = CHUNK_WORDS) -> Column:
    """One chunk for each top-level definition; what stands before the first opens its chunk.
    Chunks of over twice the budget are cut as prose, and so is code without definitions."""
    parts = F.split(c, rf"(?:\A|(?<={LINE_ENDS}))(?={DEFINITION})")
    blocks = F.filter(parts, lambda x: x.rlike(rf"\A{DEFINITION}"))
    head = F.when(~parts[0].rlike(rf"\A{DEFINITION}"), strip(parts[0])).otherwise("")
    whole = F.transform(blocks, lambda x, k: F.when((k == 0) & (head != ""), F.concat(head, F.lit("\n\n"), strip(x))).otherwise(strip(x)))
    cut = F.flatten(F.transform(whole, lambda x: F.when(word_count(x) > 2 * words, chunk_prose(x, words)).otherwise(F.array(x))))
    return F.when(F.size(blocks) > 0, cut).otherwise(chunk_prose(c, words))


class _Outline(ast.NodeVisitor):
    """What a module imports and defines at its top level, and the methods of its classes."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.owner: str | None = None

    def _tell(self, kind: str, name: str) -> None:
        self.rows.append({"owner": self.owner, "kind": kind, "name": name})

    def generic_visit(self, node: ast.AST) -> None:
        """Nothing inside other statements counts."""

    def visit_Module(self, node: ast.Module) -> None:
        for inner in node.body:
            self.visit(inner)

    def visit_Import(self, node: ast.Import) -> None:
        if self.owner is None:
            for alias in node.names:
                self._tell("import", alias.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if self.owner is None and node.module:
            self._tell("import", node.module)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self._tell("definition" if self.owner is None else "method", node.name)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        if self.owner is None:
            self._tell("definition", node.name)
            self.owner = node.name
            self.visit_Module(node)
            self.owner = None


def _outline(source: str | None) -> list[dict] | None:
    """None where the source is no valid Python."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    outline = _Outline()
    outline.visit(tree)
    return outline.rows


def python_outline(c: Column) -> Column:
    @F.pandas_udf(OUTLINE)
    def run(s: pd.Series) -> pd.Series:
        return s.map(_outline)

    return run(c)


def module_name(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/]*)/*$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def imports_of(c: Column) -> Column:
    """Root names of whatever looks like an import, in any language."""
    roots = F.transform(F.regexp_extract_all(c, F.lit(IMPORT), 1), lambda x: F.regexp_extract(x, r"^[^/.]*", 0))
    return F.array_distinct(F.filter(roots, lambda x: x != ""))


def structural_triples(c: Column, filename: Column) -> Column:
    """``array<struct<subject, predicate, object>>``: imports, definitions and methods; nothing for files that are no code."""
    c, name = F.coalesce(c, F.lit("")), module_name(filename)
    triple = lambda s, p, o: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))
    kinds = F.create_map(*[F.lit(x) for pair in PREDICATE_OF.items() for x in pair])
    outline = python_outline(F.when(F.lower(filename).endswith(".py"), c))
    told = F.transform(outline, lambda r: triple(F.coalesce(r["owner"], name), kinds[r["kind"]], F.when(r["kind"] == "import", F.regexp_extract(r["name"], r"^[^.]*", 0)).otherwise(r["name"])))
    plain = F.transform(imports_of(c), lambda x: triple(name, F.lit("imports"), x))
    found = F.when(F.lower(filename).endswith(".py"), F.coalesce(told, plain)).otherwise(plain)
    return F.when(F.coalesce(chunk_strategy(filename), F.lit("prose")) == "code", found).otherwise(F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))
