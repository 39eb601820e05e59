"""Two-pass retrieval and summaries of a subgraph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.functions import text
from memweave.operators import enrich, prompts, providers, render, search, traverse
from memweave.runtime import materialize

GAP_HITS, SHORT_ANSWER = 5, 100


@dataclass
class Summary:
    answer: str
    queries: list[str]
    graph: traverse.Subgraph
    markdown: str
    debug: dict = field(default_factory=dict)


def gap_seeds(nodes: DataFrame, vectors: list[Column], now: str, user_id: str = "global") -> DataFrame | None:
    """``(uuid)`` of the hits of a few more queries; the edges found are passed by, as expansion meets them."""
    hits = None
    for v in vectors:
        found = search.search_nodes(nodes, v, now, user_id=user_id, limit=GAP_HITS).select("uuid")
        hits = found if hits is None else hits.unionByName(found)
    return None if hits is None else materialize(hits.distinct(), "gap-seeds")


def fill_gaps(base: traverse.Subgraph, nodes: DataFrame | traverse.ByKey, edges: DataFrame | traverse.GraphStore | traverse.GraphView, vectors: list[Column], now: str, user_id: str = "global", query: Column | None = None) -> traverse.Subgraph:
    """The subgraph, with what a one-hop expansion around the hits of a few more queries adds."""
    seeds = gap_seeds(nodes.table if isinstance(nodes, traverse.ByKey) else nodes, vectors, now, user_id)
    return base if seeds is None else traverse.merge(base, traverse.expand(nodes, edges, seeds, query, hops=1, user_id=user_id))


def as_text(graph: traverse.Subgraph, seeds: DataFrame, sources: DataFrame | None) -> str:
    """Markdown of a subgraph, which the frontier limits keep small."""
    return "\n".join(r["line"] for r in render.markdown(graph, seeds, sources).orderBy("pos").toLocalIterator())


def explicit_seeds(spark: SparkSession, listed: str) -> DataFrame:
    """``(uuid)`` from ids between commas."""
    names = F.filter(F.transform(F.split(F.lit(listed), ","), F.trim), lambda x: x != "")
    return spark.range(1).select(F.explode(F.array_distinct(names)).alias("uuid"))


def _vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def summarize(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, query: str, now: str, ask: providers.Model, embed: providers.Embedder, user_id: str = "global", hops: int = 2, limit_per_hop: int = 20, source: str | None = None
) -> Summary:
    """Expand; draft an answer and ask what is missing; search and expand once more; then the final answer with sources.

    A question of two words or fewer is broad: it is expanded without its vector. Too short
    an answer is asked for once more.
    """
    spark = nodes.sparkSession
    broad, question = spark.range(1).select(text.is_broad_query(F.lit(query)), text.is_question(F.lit(query))).first()
    kind = "question" if question else "broad" if broad else "free"
    vector = None if broad else _vector(embed([query], providers.QUERY_TASK)[0])
    graph = traverse.expand(nodes, edges, seeds, vector, hops, limit_per_hop, user_id, source=source)
    size = lambda g: {"nodes": g.nodes.count(), "edges": g.edges.count()}
    first = size(graph)
    shown = as_text(graph, seeds, None)
    system = prompts.graph_system(kind, query)
    tell = lambda s, user, task: (ask([providers.Request(s, user, prompts.MAX_TOKENS[task])])[0] or "").strip()
    draft = tell(system, shown, "draft")
    thought = tell(prompts.thought_system(query), shown, "thought")
    queries = spark.range(1).select(text.gap_queries(F.lit(thought))).first()[0]
    found = gap_seeds(nodes, [_vector(v) for v in embed(queries, providers.QUERY_TASK)], now, user_id) if queries else None
    retrieved = [] if found is None else [r["uuid"] for r in found.orderBy("uuid").collect()]  # at most queries x GAP_HITS
    if retrieved:
        graph = traverse.merge(graph, traverse.expand(nodes, edges, found, vector, 1, limit_per_hop, user_id, source=source))
    sources = None
    if "journal_entry_ids" in graph.nodes.columns:
        sources = enrich.source_logs(graph.nodes.where(F.col("node_type") != "log"), nodes)
    shown = as_text(graph, seeds, sources)
    answer = tell(system, prompts.final_user(kind, draft, shown), "final")
    if len(answer) < SHORT_ANSWER:
        answer = tell(system, prompts.retry_user(kind, query, shown), "final")
    debug = {
        "query": query, "broad": broad, "question": question, "targets": queries, "retrieved": retrieved, "pass1": first | {"draft_chars": len(draft), "thought": thought},
        "pass2": {"performed": bool(retrieved)} | size(graph), "final": {"chars": len(answer)},
    }
    return Summary(answer, queries, graph, shown, debug)


def search_then_summarize(nodes: DataFrame, edges: DataFrame, query: str, now: str, ask: providers.Model, embed: providers.Embedder, seeds: str | None = None, limit: int = 10, user_id: str = "global", **how) -> Summary:
    """The hits of a search as seeds, or those of the list ``seeds``."""
    if seeds:
        at = explicit_seeds(nodes.sparkSession, seeds)
    else:
        found, facts = search.search(nodes, edges, _vector(embed([query], providers.QUERY_TASK)[0]), now, limit=limit, user_id=user_id)
        at = found.select("uuid").unionByName(facts.select("uuid"))
    return summarize(nodes, edges, materialize(at, "summary-seeds"), query, now, ask, embed, user_id, **how)
