"""Corpora: change detection, chunks, bridge edges and status."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memweave.functions import code, ids, text
from memweave.operators import ingest, prompts, providers
from memweave.runtime import materialize, spread
from memweave.schema import DEFAULT_DOMAIN, PREDICATES, WEIGHTS
from memweave.sources.changelog import marks


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming (corpus_id, filename, content)`` against ``stored (uuid, content_hash)``: new, changed or unchanged."""
    new = incoming.select(ids.document_id(F.col("corpus_id"), F.col("filename")).alias("uuid"), "corpus_id", "filename", ids.content_hash(F.col("content")).alias("content_hash"))
    old = stored.select("uuid", F.col("content_hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    return new.join(old, "uuid", "left").withColumn("status", status).drop("old_hash")


def chunks(docs: DataFrame, words: int = text.CHUNK_WORDS) -> DataFrame:
    """``docs (uuid, filename, content)`` to ``(document_id, chunk_index, content)``.

    Prose is cut by a native fold; only code files go through Python.
    """
    kind = text.chunk_strategy(F.col("filename"))
    out = lambda part, cut: part.select(F.col("uuid").alias("document_id"), F.posexplode(cut).alias("chunk_index", "content"))
    prose = out(docs.where(kind == "prose"), text.chunk_prose(F.col("content"), words))
    return prose.unionByName(out(docs.where(kind == "code"), code.chunk_code(F.col("content"), words)))


def chunk_nodes(cut: DataFrame, docs: DataFrame, user_id: str = "global") -> DataFrame:
    """Chunk rows as nodes; ids are made from the document and the place, so that a rerun repeats them."""
    d = docs.select(F.col("uuid").alias("document_id"), "corpus_id", "filename")
    meta = F.to_json(F.struct("document_id", "corpus_id", "filename", "chunk_index"))
    return cut.join(d, "document_id").select(
        F.concat(F.lit("chunk_"), F.sha1(F.concat_ws(":", "document_id", "chunk_index"))).alias("uuid"), F.lit("chunk").alias("node_type"), "content",
        F.lit(WEIGHTS["chunk"]).alias("weight"), meta.alias("metadata"), F.lit(user_id).alias("user_id"), F.col("corpus_id").alias("source"), "document_id", "chunk_index",
    )


def corpus_nodes(docs: DataFrame) -> DataFrame:
    """One hub a corpus; its content lists the files in order of ``pos`` where there is one, else by name."""
    order = F.col("pos") if "pos" in docs.columns else F.col("filename")
    files = docs.groupBy("corpus_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "filename"))).alias("f"))
    names = F.array_join(F.transform("f", lambda x: x["filename"]), ", ")
    return files.select(
        ids.corpus_id(F.col("corpus_id")).alias("uuid"), F.lit("corpus").alias("node_type"), F.concat(F.lit("Corpus '"), F.col("corpus_id"), F.lit("': "), names).alias("content"),
        F.lit(WEIGHTS["corpus"]).alias("weight"), F.to_json(F.struct("corpus_id", F.size("f").alias("file_count"))).alias("metadata"), F.col("corpus_id").alias("source"),
    )


def _edge(subject: Column, predicate: str, object_: Column) -> list[Column]:
    return [ids.edge_id(subject, F.lit(predicate), object_).alias("uuid"), subject.alias("subject_uuid"), F.lit(predicate).alias("predicate"), object_.alias("object_uuid")]


def has_chunk(nodes: DataFrame) -> DataFrame:
    return nodes.select(*_edge(F.col("document_id"), "has_chunk", F.col("uuid")))


def next_chunk(nodes: DataFrame) -> DataFrame:
    before = F.lag("uuid").over(Window.partitionBy("document_id").orderBy("chunk_index"))
    return nodes.withColumn("before", before).where("before IS NOT NULL").select(*_edge(F.col("before"), "next_chunk", F.col("uuid")))


def contains(docs: DataFrame) -> DataFrame:
    """From each hub to its new documents."""
    new = docs.where("status = 'new'") if "status" in docs.columns else docs
    return new.select(*_edge(ids.corpus_id(F.col("corpus_id")), "contains", F.col("uuid")))


def has_summary(summaries: DataFrame) -> DataFrame:
    return summaries.select(*_edge(F.col("document_id"), "has_summary", F.col("uuid")))


def mentioned_in(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``names (document_id, entity_uuid, name)``: an entity stands in a chunk of its document as whole words.

    The document is the join key; the words are a condition on its pairs.
    """
    met = names.where("trim(name) <> ''").join(nodes.select("document_id", "uuid", "content"), "document_id").where(text.mentions(F.col("content"), F.col("name")))
    return met.select(*_edge(F.col("entity_uuid"), "mentioned_in", F.col("uuid"))).distinct()


def structural_edges(docs: DataFrame) -> DataFrame:
    """Imports, definitions and methods of code files as ``(subject, predicate, object, types)``."""
    rows = docs.select(F.col("uuid").alias("document_id"), F.inline(code.structural_triples(F.col("content"), F.col("filename"))))
    return rows.withColumn("subject_type", F.lit("module")).withColumn("object_type", F.when(F.col("predicate") == "imports", "module").otherwise(F.lit("function")))


def status(document_ids: DataFrame, nodes: DataFrame, since: str | None = None) -> DataFrame:
    """``(total, completed, failed, is_complete)`` of ``document_ids (uuid)``; an error once recorded counts for good."""
    n = nodes.select("uuid", "pipeline_done_at", "pipeline_error")
    j = document_ids.select("uuid").distinct().join(n, "uuid", "left")
    done = F.col("pipeline_done_at").isNotNull()
    if since:
        done = done & (F.col("pipeline_done_at") >= F.lit(since))
    failed = done & F.col("pipeline_error").isNotNull()
    out = j.agg(F.count(F.lit(1)).alias("total"), F.count_if(done & ~failed).alias("completed"), F.count_if(failed).alias("failed"))
    return out.withColumn("is_complete", F.col("completed") + F.col("failed") >= F.col("total"))


def active_chunks(document_ids: DataFrame, nodes: DataFrame, user_id: str = "global") -> DataFrame:
    own = nodes.where((F.col("node_type") == "chunk") & (F.col("user_id") == user_id) & (F.col("weight") > 0))
    return own.join(document_ids.select(F.col("uuid").alias("document_id")), "document_id", "left_semi")


def tombstone_chunks(nodes: DataFrame, document_ids: DataFrame, user_id: str = "global") -> DataFrame:
    """``nodes`` with the weight of those documents' chunks at 0."""
    hit = document_ids.select(F.col("uuid").alias("document_id")).distinct().withColumn("hit", F.lit(True))
    out = nodes.join(hit, "document_id", "left")
    dead = F.col("hit") & (F.col("node_type") == "chunk") & (F.col("user_id") == user_id)
    return out.withColumn("weight", F.when(dead, F.lit(0.0)).otherwise(F.col("weight"))).select(*nodes.columns)


@dataclass
class CorpusIngest:
    status: DataFrame  # uuid, corpus_id, filename, content_hash, status
    nodes: DataFrame  # hubs, documents, summaries, chunks and entities to write
    edges: DataFrame  # bridge, structural and summary edges to write
    dead: DataFrame  # uuids of chunks that a change has replaced
    failed: DataFrame  # (uuid, error): documents whose pipeline failed; the others are not touched by it
    marks: DataFrame  # (uuid, pipeline_done_at, pipeline_error) of all documents that went through
    ingested: ingest.Ingested  # what the summaries' own ingest did
    acks: DataFrame  # (id): nodes created and updated


def document_nodes(found: DataFrame, incoming: DataFrame, user_id: str = "global") -> DataFrame:
    """New and changed documents; metadata holds the hash that the next run compares."""
    meta = F.to_json(F.struct("filename", "corpus_id", "content_hash"))
    texts = incoming.select(ids.document_id(F.col("corpus_id"), F.col("filename")).alias("uuid"), F.substring("content", 1, 10_000).alias("content"))
    return found.where("status <> 'unchanged'").join(texts, "uuid").select(
        "uuid", F.lit("document").alias("node_type"), "content", F.lit(WEIGHTS["document"]).alias("weight"), meta.alias("metadata"), F.col("corpus_id").alias("source"), F.lit(user_id).alias("user_id")
    )


def structural_nodes(facts: DataFrame, user_id: str = "global") -> DataFrame:
    """The modules and functions that structural facts name."""
    ends = [facts.select(ids.entity_id(F.col(f"{s}_type"), F.col(s)).alias("uuid"), F.col(f"{s}_type").alias("node_type"), F.col(s).alias("content")) for s in ("subject", "object")]
    one = ends[0].unionByName(ends[1]).groupBy("uuid").agg(F.min(F.struct("node_type", "content")).alias("n"))
    return one.select("uuid", "n.*", ids.name_key(F.col("n.content")).alias("name_key"), F.lit(WEIGHTS["entity"]).alias("weight"), F.lit(user_id).alias("user_id"))


def ingest_corpus(
    incoming: DataFrame,
    stored: DataFrame,
    nodes: DataFrame,
    user_id: str = "global",
    words: int = text.CHUNK_WORDS,
    at: str = "1970-01-01T00:00:00+00:00",
    known_predicates: DataFrame | list[str] = tuple(PREDICATES),
    make: Callable = providers.rules,
    answers: Mapping[str, Column | str] | None = None,
    domain: str = DEFAULT_DOMAIN,
    **how,
) -> CorpusIngest:
    """``incoming (corpus_id, filename, content)`` against ``stored (uuid, content_hash)`` and ``nodes``.

    Unchanged documents cost a hash and a join. All others go through the stages at once, as
    tasks and not as one call each: summary, ingest of the summary, chunks, and the edges
    ``contains``, ``has_summary``, ``has_chunk``, ``next_chunk``, ``mentioned_in`` and those of
    code. A document whose summary or extraction fails is marked as failed, and keeps only its
    own node and its place in the corpus.
    """
    found = materialize(classify(incoming, stored), "documents-found")
    todo = found.where("status <> 'unchanged'").join(incoming.select("corpus_id", "filename", "content"), ["corpus_id", "filename"])
    todo = materialize(spread(todo, "uuid"), "documents-to-do")
    ask = ingest.Asker(make, answers)
    told = materialize(ask(todo, "summary", prompts.document_summary(F.col("content"), F.col("filename"))).select("uuid", "corpus_id", "filename", ids.strip(F.coalesce("said", F.lit(""))).alias("summary"), "said_error"), "summaries")
    entry = F.concat(F.lit("summary_"), F.col("uuid"))
    meta = F.to_json(F.struct(F.col("uuid").alias("document_id"), "filename", F.lit(True).alias("is_summary")))
    entries = told.where("summary <> ''").select(entry.alias("entry_id"), F.col("summary").alias("text"), F.lit(user_id).alias("user_id"), F.lit(domain).alias("domain"), F.col("corpus_id").alias("source"), F.lit(at).cast("timestamp").alias("at"), meta.alias("metadata"))
    done = ingest.ingest(entries, nodes, known_predicates if isinstance(known_predicates, DataFrame) else list(known_predicates), make, answers=answers, **how)
    of_entry = told.select(entry.alias("entry_id"), F.col("uuid").alias("document_id"))
    failed = told.where("said_error IS NOT NULL").select("uuid", F.col("said_error").alias("error")).unionByName(done.failed.join(of_entry, "entry_id").select(F.col("document_id").alias("uuid"), "error"))
    failed = materialize(failed, "failed-documents")
    good = todo.join(failed.select("uuid"), "uuid", "left_anti")
    cut = materialize(chunk_nodes(chunks(good.select("uuid", "filename", "content"), words), good.select("uuid", "corpus_id", "filename"), user_id), "chunks")
    summaries = done.logs.join(of_entry, "entry_id").join(failed.select(F.col("uuid").alias("document_id")), "document_id", "left_anti")
    names = done.named.join(of_entry, "entry_id").select("document_id", F.col("uuid").alias("entity_uuid"), F.col("content").alias("name"))
    code_facts = structural_edges(good)
    s, o = (ids.entity_id(F.col(f"{x}_type"), F.col(x)) for x in ("subject", "object"))
    facts = code_facts.select(ids.edge_id(s, F.col("predicate"), o).alias("uuid"), s.alias("subject_uuid"), "predicate", o.alias("object_uuid")).distinct()
    links = [has_chunk(cut), next_chunk(cut), contains(found), has_summary(summaries.select("document_id", "uuid")), mentioned_in(names, cut), facts]
    edges = ingest.union([*links, done.edges.drop("embedding")]).dropDuplicates(["uuid"])
    written = ingest.union([corpus_nodes(incoming), document_nodes(found, incoming, user_id), cut, done.logs.drop("embedding"), done.nodes.drop("embedding"), structural_nodes(code_facts, user_id)])
    # an entity that code and a summary both name is one node
    written = written.dropDuplicates(["uuid"])
    changed = found.where("status = 'changed'").select("uuid")
    dead = active_chunks(changed, nodes, user_id).join(cut.select("uuid"), "uuid", "left_anti").select("uuid")
    marked = marks(0, todo, failed, at).select("uuid", "pipeline_done_at", "pipeline_error")
    own = found.where("status <> 'unchanged'").select(F.col("uuid").alias("id"), F.when(F.col("status") == "new", "created").otherwise("updated").alias("kind"))
    return CorpusIngest(found, written, edges, dead, failed, marked, done, ingest.touched_ids(own.unionByName(done.acks.select("id", "kind"))))
