"""Text ingest as staged tables: log, extraction, predicate gate, resolution, collisions, facts, supersession.

A batch of texts goes through all stages at once, with the results of one-entry batches in
the order of time, entry and place where order decides: a name approved by one entry is
known to the next, a fact may replace an earlier one of the batch, and each touch moves
``updated_at``. Entities are resolved against the state before the batch and the batch's
own new ones. Stable ids make repeated names one node and repeated facts one edge.

A store that hands out rows by key (``sources.keyed``) in place of a table is asked for the
rows that the batch names, and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memweave.functions import ids, text
from memweave.operators import enrich, prompts, providers, recent, resolve
from memweave.runtime import materialize
from memweave.sources import changelog
from memweave.schema import CORE_DOMAIN, DEFAULT_DOMAIN, DEFAULT_USER, NODE_TYPES, WEIGHTS

UNRESOLVED = "unresolved id or placeholder"


@dataclass
class Ingested:
    """Nodes, edges and acknowledgements are computed when they are first read."""

    logs: DataFrame
    make_nodes: Callable[[], DataFrame]
    make_edges: Callable[[], DataFrame]
    rejected: DataFrame  # triples that were not taken, and why
    predicates: DataFrame  # (name): new ones
    renamed: DataFrame  # (uuid, content, name_key): nodes that a colliding name updates
    tombstones: DataFrame  # (uuid): facts, stored or of the batch, that a later one replaces
    make_acks: Callable[[], DataFrame]
    named: DataFrame  # (entry_id, uuid, content): the entities of each entry
    failed: DataFrame  # (entry_id, error): entries whose extraction failed
    stored_edges: DataFrame | None = None  # the stored facts that were looked at

    @cached_property
    def nodes(self) -> DataFrame:
        """One row for each entity named, with whether it was there before (then only its journal grows)."""
        return self.make_nodes()

    @cached_property
    def edges(self) -> DataFrame:
        """One row for each fact, likewise."""
        return self.make_edges()

    @cached_property
    def acks(self) -> DataFrame:
        """``(entry_id, id, kind)``: nodes created and updated, facts named, by entry."""
        return self.make_acks()


class Asker:
    """Answers from a model, or from columns by task. A task without a column then has no answer."""

    def __init__(self, make: Callable = providers.rules, answers: Mapping[str, Column | str] | None = None):
        self.make, self.answers = make, answers

    def answers_to(self, task: str) -> bool:
        return self.answers is None or task in self.answers

    def __call__(self, df: DataFrame, task: str, prompt: Column) -> DataFrame:
        if self.answers is None:
            return providers.ask(df, prompt, "said", self.make, prompts.SYSTEM[task], prompts.MAX_TOKENS[task])
        own = self.answers.get(task, F.lit(None).cast("string"))
        return df.select("*", (F.col(own) if isinstance(own, str) else own).alias("said"), F.lit(None).cast("string").alias("said_error"))


def log_id(user: Column, entry: Column) -> Column:
    return F.concat(F.lit("log_"), F.sha1(F.concat_ws(":", user, entry)))


def log_nodes(entries: DataFrame) -> DataFrame:
    """``entries (entry_id, text, user_id, domain, source, at)`` as log nodes."""
    meta = F.coalesce("metadata", F.lit("{}")) if "metadata" in entries.columns else F.lit("{}")
    return entries.select(
        log_id(F.col("user_id"), F.col("entry_id")).alias("uuid"), F.lit("log").alias("node_type"), F.col("text").alias("content"), F.coalesce("domain", F.lit(DEFAULT_DOMAIN)).alias("domain"),
        F.lit(WEIGHTS["log"]).alias("weight"), "user_id", "source", meta.alias("metadata"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), "entry_id",
    )


def extracted(entries: DataFrame, known: DataFrame, ask: Asker) -> tuple[DataFrame, DataFrame]:
    """``(entry_id, user_id, at, pos, subject, predicate, object, types, is_new, triple_id)``, and the entries that failed."""
    names = known.agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("known_names"))  # one row, a vocabulary
    asked = ask(entries.crossJoin(names), "extract", prompts.extraction(F.col("text"), F.lit(", ".join(NODE_TYPES)), F.col("known_names")))
    asked = asked.select("entry_id", "user_id", "at", "said", "said_error")
    asked = asked if ask.answers is not None else materialize(asked, "extraction")  # a model is asked once
    told = asked.select("entry_id", "user_id", "at", F.posexplode(text.refinery_facts(F.col("said"))).alias("pos", "t")).select("entry_id", "user_id", "at", "pos", "t.*")
    told = told.withColumn("is_new", ids.is_new_predicate(F.col("predicate"))).withColumn("predicate", ids.normalized_predicate(F.col("predicate")))
    return told.withColumn("triple_id", F.concat_ws(":", "user_id", "entry_id", "pos")), asked.where("said_error IS NOT NULL").select("entry_id", F.col("said_error").alias("error"))


def _order() -> Column:
    """The place of a triple among all, as a string that sorts."""
    return F.concat_ws("\x1f", F.lpad((F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(0)) + (1 << 62)).cast("string"), 20, "0"), "entry_id", F.lpad(F.col("pos").cast("string"), 10, "0"), "user_id")


def gated(told: DataFrame, known: DataFrame, ask: Asker) -> DataFrame:
    """Proposed predicates become the known ones that an answer names; without such an answer they stay (``appended``).

    A name that stays is known to all triples after it. Answers depend on what is known, so
    a round asks all open proposals with the names so far; the first of them that adds a
    name settles those before it, and the others are asked again: a round for each new name.
    """
    open_, parts, names = told.where("is_new").withColumn("order", _order()), [], {r["name"] for r in known.collect()}  # a vocabulary
    columns = [c for c in told.columns if c != "predicate"]
    while True:
        said = ask(open_.withColumn("known_names", F.lit(", ".join(sorted(names)))), "gate", prompts.gate(F.col("predicate"), F.col("subject"), F.col("object"), F.col("known_names")))
        named = text.gate_name(F.col("said"))
        final = F.when(named.isin(*names), named).otherwise(F.col("predicate")) if names else F.col("predicate")
        said = materialize(said.select(*columns, "order", F.col("predicate").alias("proposed"), final.alias("predicate")), "gate")
        new = said.where((F.col("predicate") == F.col("proposed")) & ~F.col("predicate").isin(*names)) if names else said
        first = new.agg(F.min(F.struct("order", "predicate")).alias("f")).first()["f"]
        settled = said if first is None else said.where(F.col("order") <= first["order"])
        parts.append(settled.select(*columns, "predicate", (F.col("predicate") == F.col("proposed")).alias("appended")))
        if first is None:
            break
        names.add(first["predicate"])
        open_ = said.where(F.col("order") > first["order"]).withColumn("predicate", F.col("proposed")).drop("proposed")
        if open_.isEmpty():
            break
    return union([told.where("NOT is_new").withColumn("appended", F.lit(False)), *parts])


def _resolved(told: DataFrame, nodes: DataFrame, ask: Asker, embed: Callable[[Column], Column] | None, threshold: float, collisions: bool) -> tuple[DataFrame, DataFrame]:
    """``(term_id, text, type, uuid, existed, known_by_id, rejected)`` of every distinct term, and renamed nodes."""
    side = lambda s: told.select(_term(s).alias("term_id"), F.col(s).alias("term"), F.col(f"{s}_type").alias("node_type"), "user_id", "at", "entry_id", "pos", F.lit(s).alias("side"))
    first = F.min(F.struct("at", "entry_id", "pos", F.when(F.col("side") == "subject", 0).otherwise(1).alias("side"))).alias("first")
    have = nodes.columns
    plain = embed is None and "name_key" not in have  # by stable id alone
    both, term = side("subject").unionByName(side("object")), ["term_id", "term", "node_type", "user_id"]
    placed = embed is not None or collisions  # what asks for the first place of a term; without it no row is sorted
    terms = (both.groupBy(*term).agg(first) if placed else both.select(*term).distinct()).withColumn("told_type", F.col("node_type"))
    found = resolve.resolve_terms(terms, nodes)
    found = found.withColumn("type", F.coalesce("resolved_type", "told_type")).drop("resolved_type", "told_type")
    stable = ids.entity_id(F.col("type"), F.col("text"))
    renamed = None
    if plain:
        out = found.withColumn("uuid", F.coalesce("uuid", F.when(~F.col("rejected"), stable))).withColumn("stable", F.col("uuid"))
    else:
        found = materialize(found, "found-terms")
        open_ = found.where("uuid IS NULL AND NOT rejected")
        # one mention for each wording and type, whoever uses it
        mention = F.sha1(F.concat_ws("\x1f", "type", "text"))
        m = open_.groupBy("type", "text").agg(F.min("first").alias("first")) if placed else open_.select("type", "text").distinct()
        m = m.select(mention.alias("mention_id"), F.col("text").alias("name"), F.col("type").alias("node_type"), *["first"] * placed)
        m = materialize(m if embed is None else m.withColumn("embedding", embed(F.col("name"))), "entity-mentions")
        store = nodes if "embedding" in have else nodes.withColumn("embedding", F.lit(None).cast("array<float>"))
        store = store if "name_key" in have else store.withColumn("name_key", F.lit(None).cast("string"))
        got = materialize(resolve.resolve(m, store, threshold), "resolved")
        if embed is not None:
            # a new mention may be the match of a later one
            rank = F.concat_ws("\x1f", F.lpad((F.coalesce(F.unix_micros(F.col("first.at").cast("timestamp")), F.lit(0)) + (1 << 62)).cast("string"), 20, "0"), "first.entry_id", F.lpad(F.col("first.pos").cast("string"), 10, "0"), "first.side", "mention_id")
            new = m.join(got.where("how = 'new'").select("mention_id"), "mention_id", "left_semi").withColumn("pos", rank)
            new = resolve.greedy_resolution(new, threshold).select("mention_id", F.col("uuid").alias("led"))
            got = got.join(new, "mention_id", "left").select("mention_id", F.coalesce("led", "uuid").alias("uuid"), "how")
        at = open_.select("term_id", mention.alias("mention_id")).join(got, "mention_id").select("term_id", "uuid")
        if collisions:
            met = got.where("how = 'vector'").join(m, "mention_id").join(nodes.select("uuid", F.col("content").alias("stored")), "uuid")
            said = ask(met, "collide", prompts.collision(F.col("name"), F.col("stored"))).where(F.lower("said").contains("update"))
            renamed = said.groupBy("uuid").agg(F.max_by("name", F.struct("first", "name")).alias("content")).withColumn("name_key", ids.name_key(F.col("content")))
        out = found.join(at.withColumnRenamed("uuid", "placed"), "term_id", "left").withColumn("uuid", F.coalesce("uuid", "placed")).withColumn("stable", F.when(F.col("placed").isNotNull(), stable).otherwise(F.col("uuid")))
    stored = nodes.select(F.col("uuid").alias("stored_id"), F.col("content").alias("stored"), F.col("node_type").alias("stored_type"))
    out = out.join(stored, F.col("uuid") == F.col("stored_id"), "left")
    out = out.withColumn("by_id", F.col("stored_id")) if plain else out.join(nodes.select(F.col("uuid").alias("by_id")), F.col("stable") == F.col("by_id"), "left")
    out = out.select(
        "term_id", F.coalesce(F.when(F.col("stored") != "", F.col("stored")), "text").alias("text"), F.coalesce("stored_type", "type").alias("type"), "uuid", F.col("stored_id").isNotNull().alias("existed"), F.col("by_id").isNotNull().alias("known_by_id"), "rejected"
    )
    if renamed is None:
        renamed = out.limit(0).select("uuid", F.col("text").alias("content"), F.col("text").alias("name_key"))
    return materialize(out, "placed-terms"), renamed


def _keys(told: DataFrame) -> DataFrame:
    """``(key)``: ids and name keys of nodes that the terms of triples may mean."""
    one = lambda s: told.select(F.col(s).alias("term"), F.col(f"{s}_type").alias("kind"), "user_id")
    terms = one("subject").unionByName(one("object")).distinct().withColumn("bare", ids.strip(F.coalesce("term", F.lit(""))))
    keys = F.array(F.col("bare"), ids.entity_id(F.col("kind"), F.col("bare")), ids.self_id(F.col("user_id")), ids.name_key(F.col("bare")))
    return terms.select(F.explode(keys).alias("key")).distinct()


def _term(side: str) -> Column:
    return F.unhex(F.sha1(F.concat_ws("\x1f", F.coalesce(f"{side}_type", F.lit("")), F.col(side), F.col("user_id"))))


def replaced(facts: DataFrame, edges: DataFrame, ask: Asker) -> DataFrame:
    """``(uuid)`` of facts, stored or of this batch, that the model says a later one of ``facts`` replaces.

    ``facts (order, uuid, user_id, subject_uuid, content, at)`` has a row each time that a fact is
    told. It is shown the ten newest facts of its user and subject as they stand at that
    moment, dead ones among them; its own takes up a place before it is left out. An
    answer counts only if it is the id of one of these. A fact belongs to the user who told
    it first.
    """
    subjects = facts.select("subject_uuid").distinct()
    stored = edges.join(subjects, "subject_uuid", "left_semi").select("uuid", "user_id", "subject_uuid", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62))).alias("stamp"))
    stored = materialize(stored, "subject-facts")
    first = facts.groupBy("uuid").agg(F.min_by(F.struct("user_id", "content"), "order").alias("f"))
    had = stored.groupBy("uuid").agg(F.first("user_id").alias("had_user"), F.first("content").alias("had_content"))
    owner = first.join(had, "uuid", "left").select("uuid", F.coalesce("had_user", "f.user_id").alias("owner"), F.coalesce("had_content", "f.content").alias("owned"))
    of = lambda user: F.base64(F.unhex(F.sha1(F.concat_ws("\x1f", user, "subject_uuid")))).alias("key")
    told = facts.join(owner, "uuid")
    touches = stored.select(of("user_id"), F.lit("").alias("order"), "uuid", "content", "stamp").unionByName(
        told.select(of("owner"), "order", "uuid", F.col("owned").alias("content"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62))).alias("stamp"))
    )
    asked = facts.select(F.lit("").alias("id"), of("user_id"), "order", "uuid", "content")
    shown = recent.newest(asked, touches, resolve.FACTS).withColumnRenamed("uuid", "fact_uuid")
    others = F.transform(F.filter("items", lambda x: (x["uuid"] != F.col("fact_uuid")) & (F.trim(x["content"]) != "")), lambda x: F.struct(x["uuid"].alias("uuid"), F.trim(x["content"]).alias("content")))
    by = shown.select("fact_uuid", "content", others.alias("facts")).where(F.size("facts") > 0)
    said = ask(by, "supersede", prompts.supersede(F.col("content"), F.col("facts")))
    hit = text.superseded(F.col("said"), F.transform("facts", lambda x: x["uuid"]))
    return said.select(hit.alias("uuid")).where("uuid IS NOT NULL").distinct()


def ingest(
    entries: DataFrame,
    nodes,
    known_predicates: DataFrame | list[str],
    make: Callable = providers.rules,
    answer: str | None = None,
    answers: Mapping[str, Column | str] | None = None,
    edges=None,
    embed: Callable[[Column], Column] | None = None,
    threshold: float = resolve.NEAR,
    collisions: bool = False,
) -> Ingested:
    """All stages for a batch of ``entries (entry_id, text, user_id, domain, source, at)``.

    Answers come from the model that ``make`` makes, or from columns: ``answers`` by task,
    ``answer`` for the extraction alone. Names match stored nodes by vector with ``embed``, by name where ``nodes``
    has ``name_key``, and by stable id. ``edges`` lets new facts replace earlier ones;
    ``collisions`` lets a name that matched by vector update its node.
    """
    spark = entries.sparkSession
    ask = Asker(make, answers if answers is not None else {"extract": answer} if answer else None)
    known = known_predicates if isinstance(known_predicates, DataFrame) else spark.createDataFrame([(p,) for p in known_predicates], "name string")
    known = known.select("name").distinct()
    entries = entries.withColumn("user_id", F.coalesce("user_id", F.lit(DEFAULT_USER)))
    logs = log_nodes(entries)
    told, failed = extracted(entries, known, ask)
    told = gated(materialize(told, "told"), known, ask)  # parts of written tables
    if not isinstance(nodes, DataFrame):
        nodes = materialize(nodes.pick(_keys(told), whole=embed is not None), "picked-nodes")
    new_predicates = told.where("appended").select(F.col("predicate").alias("name")).distinct().join(known, "name", "left_anti")
    terms, renamed = _resolved(told, nodes, ask, embed, threshold, collisions)
    full = told
    for s in ("subject", "object"):
        of = terms.select(F.col("term_id").alias(f"{s}_key"), F.col("text").alias(f"{s}_text"), F.col("uuid").alias(f"{s}_uuid"), F.col("type").alias(f"{s}_kind"), F.col("existed").alias(f"{s}_existed"), F.col("known_by_id").alias(f"{s}_known"), F.col("rejected").alias(f"{s}_bad"))
        full = full.withColumn(f"{s}_key", _term(s)).join(of, f"{s}_key").drop(f"{s}_key")
    full = materialize(full, "resolved-triples")  # what follows reads them several times
    bad = F.col("subject_bad") | F.col("object_bad")
    rejected = full.where(bad).select("triple_id", "subject", "predicate", "object", F.lit(UNRESOLVED).alias("reason"))
    log_uuid = log_id(F.col("user_id"), F.col("entry_id")).alias("log_uuid")
    good = full.where(~bad)
    ends = [
        F.struct(F.col(f"{s}_uuid").alias("uuid"), F.col(f"{s}_kind").alias("node_type"), F.col(f"{s}_text").alias("content"), F.col(f"{s}_existed").alias("existed"), F.col(f"{s}_known").alias("known_by_id"), F.lit(k).alias("side"))
        for k, s in enumerate(("subject", "object"))
    ]
    named = good.select("user_id", "at", "entry_id", "pos", log_uuid, F.inline(F.array(*ends)))
    journal = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("at", "entry_id", "log_uuid"))), lambda x: x["log_uuid"]))
    head = F.min(F.struct("at", "entry_id", "pos", "side", "node_type", "content", "user_id", "existed", "known_by_id")).alias("f")
    ents = lambda: materialize(named.groupBy("uuid").agg(head, journal.alias("journal_entry_ids"), F.max("at").alias("updated_at")).select(
        "uuid", "f.node_type", "f.content", "f.user_id", F.col("f.at").alias("created_at"), "updated_at", "journal_entry_ids", "f.existed", "f.known_by_id", F.col("f.entry_id").alias("first_entry")), "entities")
    by_entry = named.select("entry_id", "uuid", "content").distinct()
    facts = good.select(
        ids.edge_id(F.col("subject_uuid"), F.col("predicate"), F.col("object_uuid")).alias("uuid"), "subject_uuid", "predicate", "object_uuid",
        ids.edge_text(F.col("subject_text"), F.col("predicate"), F.col("object_text")).alias("content"), "user_id", "at", "entry_id", _order().alias("order"), log_uuid,
    )
    dead = full.limit(0).select(F.col("subject_uuid").alias("uuid"))
    if edges is not None:
        if not isinstance(edges, DataFrame):
            edges = materialize(edges.pick(good.select(F.col("subject_uuid").alias("key"))), "picked-edges")
    if edges is not None and ask.answers_to("supersede"):  # without an answer nothing is replaced
        dead = materialize(replaced(materialize(facts.select("order", "uuid", "user_id", "subject_uuid", "content", "at").dropDuplicates(["order"]), "facts-told"), edges, ask), "replaced")
    embedded = lambda df: df if embed is None else df.withColumn("embedding", embed(F.col("content")))
    held = {}

    def entities() -> DataFrame:
        if not held:
            held["entities"] = ents()
        return held["entities"]

    def made_nodes() -> DataFrame:
        return embedded(entities().drop("known_by_id", "first_entry").withColumn("name_key", ids.name_key(F.col("content"))).withColumn("weight", F.lit(WEIGHTS["entity"])))

    def made_edges() -> DataFrame:
        made = facts.groupBy("uuid").agg(*[F.min_by(c, "order").alias(c) for c in ("subject_uuid", "predicate", "object_uuid", "content", "user_id")], F.min("at").alias("created_at"), F.max("at").alias("updated_at"), journal.alias("journal_entry_ids"))
        made = materialize(made.withColumn("weight", F.lit(WEIGHTS["edge"])), "facts")
        if edges is None:
            return embedded(made.withColumn("existed", F.lit(False)))
        stored = edges.select("uuid").distinct().withColumn("existed", F.lit(True))
        return embedded(made.join(stored, "uuid", "left").withColumn("existed", F.coalesce("existed", F.lit(False))))

    def acks() -> DataFrame:
        # no journals: those of hot entities are as long as the batch, and only the first entry counts
        firsts = named.groupBy("uuid").agg(head).where("NOT f.known_by_id").select(F.col("f.entry_id").alias("entry_id"), "uuid", F.lit(1).alias("new"))
        # a key of both is no hot one; what is created is among what is named
        told = named.select("entry_id", "uuid", F.lit(0).alias("new")).unionByName(firsts).groupBy("entry_id", "uuid").agg(F.max("new").alias("new"))
        of_nodes = told.select("entry_id", F.col("uuid").alias("id"), F.when(F.col("new") == 1, "created").otherwise("updated").alias("kind"))
        return of_nodes.unionByName(facts.select("entry_id", F.col("uuid").alias("id"), F.lit("fact").alias("kind")).distinct())

    return Ingested(embedded(logs), made_nodes, made_edges, rejected, new_predicates, renamed, dead, acks, by_entry, failed, edges)


#: What a row that was there before does not change.
KEPT = ["content", "weight", "name_key", "embedding", "node_type", "created_at"]


def changes(number: int, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``Ingested.nodes`` or ``.edges`` for a change log: new ones are created, others only touched."""
    old = F.col("existed") if "existed" in rows.columns else F.lit(False)
    own = [F.when(~old, F.col(c)).alias(c) if c in KEPT else F.col(c) for c in columns if c in rows.columns]
    place = F.when(old, F.lit(changelog.seq(number, changelog.TOUCHED))).otherwise(F.lit(changelog.seq(number, changelog.CREATED)))
    return rows.select(place.cast("long").alias("seq"), F.when(old, "touch").otherwise("create").alias("op"), *own)


def consolidation_entries(logs: DataFrame, at: Column, make: Callable = providers.rules, answer: Column | None = None) -> DataFrame:
    """Up to three statements on each user's newest logs, as entries of the core domain."""
    ask = Asker(make, None if answer is None else {"consolidate": answer})
    told = ask(enrich.newest_logs(logs), "consolidate", prompts.consolidation(F.col("batch")))
    rows = told.select("user_id", F.posexplode(text.statements(F.col("said"))).alias("pos", "text"))
    return rows.select(F.concat(F.lit("core_"), F.sha1(F.concat_ws(":", "user_id", "text"))).alias("entry_id"), "text", "user_id", F.lit(CORE_DOMAIN).alias("domain"), F.lit("consolidation").alias("source"), at.alias("at"))


def consolidate(logs: DataFrame, nodes: DataFrame, known_predicates: DataFrame | list[str], at: Column, make: Callable = providers.rules, answers: Mapping[str, Column] | None = None, **how) -> Ingested:
    """The statements on each user's newest logs go through ingest themselves."""
    own = None if answers is None else answers["consolidate"]
    entries = consolidation_entries(logs, at, make, own).dropDuplicates(["entry_id"])
    return ingest(materialize(entries, "statements"), nodes, known_predicates, make, answers=None if answers is None else {k: v for k, v in answers.items() if k != "consolidate"}, **how)


def merged_outcomes(outcomes: DataFrame) -> DataFrame:
    """``(id, kind)`` over documents ``(pos, id, kind)``: the first place of each id and kind counts; an update
    after a creation is dropped, one before it stays."""
    first = outcomes.groupBy("id", "kind").agg(F.min("pos").alias("pos"))
    created = F.min(F.when(F.col("kind") == "created", F.col("pos"))).over(Window.partitionBy("id"))
    return first.withColumn("created_pos", created).where("kind = 'created' OR created_pos IS NULL OR pos < created_pos").select("pos", "id", "kind")


def touched_ids(outcomes: DataFrame) -> DataFrame:
    """``(id)``: created and updated ids as one set."""
    return outcomes.where("kind IN ('created', 'updated')").select("id").distinct()


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
