"""Queries of the graph operators over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memweave.functions import ids, scoring, text
from memweave.operators import bulk, corpus, enrich, ingest, listing, render, resolve, search, summarize, traverse
from memweave.plans.expand_sql import expand_requests_sql, expand_sql
from memweave.plans.fixtures import LOGS_NOW, NODES_NOW, Graph, with_views
from memweave.runtime import materialize, new_path
from memweave.schema import NODE_TYPES, PREDICATES
from memweave.sources import changelog
from memweave.sources.keyed import KeyedLog
from memweave.sources.vocabulary import Vocabulary
from memweave.streaming import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, *views: str):
    """The function's query under its name; ``sql`` may use the views."""

    def keep(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return keep


NATION_0 = "'entity_' || sha1('place:nation_0')"
ME = "'entity_' || sha1('self:global')"
V0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def seed(g: Graph, *names: str) -> DataFrame:
    rows = [(n,) for n in names]
    made = g.spark.createDataFrame(rows, "name string")
    return made.select(F.when(F.col("name") == "SELF", ids.self_id(F.lit("global"))).otherwise(ids.entity_id(F.lit("place"), F.col("name"))).alias("uuid"))


# Statistics and listings


@register("SELECT coalesce(node_type, 'unknown') AS node_type, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def stats_nodes_by_type(g):
    return listing.counts(g.node_keys, "node_type")


@register("SELECT coalesce(predicate, 'unknown') AS predicate, count(*) AS n FROM edges GROUP BY 1", "edges")
def stats_edges_by_predicate(g):
    return listing.counts(g.edges, "predicate")


@register("SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges", "nodes", "edges")
def stats_totals(g):
    return listing.totals(g.node_keys, g.edges)


@register("SELECT 'node_type' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'predicate', predicate, count(*) FROM edges GROUP BY 2", "nodes", "edges")
def stats_report(g):
    return listing.report(g.node_keys, g.edges)


_VALUES = "SELECT * FROM (VALUES " + ", ".join(f"('node_type', '{x}')" for x in NODE_TYPES) + ", " + ", ".join(f"('predicate', '{x}')" for x in PREDICATES) + ") t(kind, name)"


@register(_VALUES)
def vocabulary(g):
    """Nothing is stored yet: the defaults."""
    return listing.vocabulary(Vocabulary(g.spark, new_path(g.spark, "vocabulary")))


@register(f"{_VALUES} UNION SELECT 'predicate', 'did_' || event_type FROM events")
def vocabulary_append(g):
    """Seeded, appended to twice, and read again."""
    stored = Vocabulary(g.spark, new_path(g.spark, "vocabulary"))
    stored.seed()
    names = g.base("events").select(F.concat(F.lit("did_"), F.col("event_type")).alias("name"))
    for some in (names, names.unionByName(g.spark.createDataFrame([("knows",)], "name string"))):
        stored.append(some)
    return listing.vocabulary(stored)


@register("SELECT 'node_type' AS kind, 'odd' AS name UNION ALL SELECT 'predicate', name FROM (" + _VALUES + ") v WHERE kind = 'predicate'")
def vocabulary_defaults(g):
    """Only node types are stored; predicates fall back to the defaults."""
    path = new_path(g.spark, "vocabulary")
    g.spark.createDataFrame([("node_type", "odd")], "kind string, name string").write.parquet(path)
    return listing.vocabulary(Vocabulary(g.spark, path))


@register("SELECT 'ok' AS status")
def health(g):
    return listing.health(g.spark)


@register(f"SELECT uuid, node_type, content, weight, user_id FROM nodes WHERE uuid = {NATION_0}", "nodes")
def node_by_uuid(g):
    key = seed(g, "nation_0").first()[0]
    return listing.by_uuid(g.nodes, key).select("uuid", "node_type", "content", "weight", "user_id")


@register("SELECT uuid, content, user_id FROM logs WHERE uuid = 'log_5'", "logs")
def entry_by_uuid(g):
    return listing.entry_by_uuid(g.logs, "log_5").select("uuid", "content", "user_id")


@register("SELECT n.uuid, n.content FROM nodes n WHERE uuid IN (SELECT object_uuid FROM edges WHERE predicate = 'owns')", "nodes")
def nodes_by_keys(g):
    keys = g.edges.where("predicate = 'owns'").select(F.col("object_uuid").alias("uuid"))
    return listing.by_uuids(g.nodes, keys).select("uuid", "content")


@register(
    """SELECT uuid, content FROM (SELECT * FROM nodes WHERE user_id = 'global' AND node_type = 'person' ORDER BY uuid LIMIT 60) t
ORDER BY updated_at ASC NULLS FIRST, uuid LIMIT 40 OFFSET 20""",
    "nodes",
)
def list_nodes_page(g):
    return listing.list_nodes(g.nodes, node_type="person", limit=40, offset=20, time="updated_at").select("uuid", "content")


@register(
    """SELECT uuid, content FROM (SELECT * FROM logs WHERE user_id = 'user_7' ORDER BY uuid LIMIT 50) t
WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00'""",
    "logs",
)
def list_entries_since(g):
    return listing.list_entries(g.logs, "user_7", "2024-01-10 00:00:00", limit=50).select("uuid", "content")


@register(
    """SELECT user_id, count(*) AS n, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS batch FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, uuid) AS rank FROM logs) t WHERE rank <= 50 GROUP BY user_id""",
    "logs",
)
def newest_logs_per_user(g):
    return enrich.newest_logs(g.logs)


@register("SELECT uuid FROM (SELECT uuid, content, vec_id FROM nodes ORDER BY uuid LIMIT 1000) t WHERE vec_id % 2 = 1 AND content <> '' ORDER BY uuid LIMIT 100", "nodes")
def backfill_plan(g):
    some = g.with_vectors(g.nodes, "vec_id").withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")))
    return listing.to_embed(some, 100).select("uuid")


@register(
    """WITH s AS (SELECT uuid FROM (SELECT uuid, content, vec_id FROM nodes ORDER BY uuid LIMIT 1000) t WHERE vec_id % 2 = 1 AND content <> '' ORDER BY uuid LIMIT 100)
SELECT n.uuid, s.uuid IS NOT NULL AS filled, CASE WHEN s.uuid IS NOT NULL THEN 64 WHEN vec_id % 2 = 0 THEN (SELECT max(len(embedding)) FROM embeddings) END AS size FROM nodes n LEFT JOIN s USING (uuid)""",
    "nodes",
)
def backfill(g):
    some = g.with_vectors(g.nodes, "vec_id").withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding").cast("array<float>")))
    out = listing.backfill(materialize(some.select("uuid", "content", "embedding"), "to-backfill"), 100)
    return out.select("uuid", "filled", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("size"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS at FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE ts END AS ts FROM events) e")
def iso_times(g):
    at = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts")).cast("timestamp")
    return g.base("events").select("event_id", scoring.iso(at).alias("at"))


# Scalar rules


@register(
    """SELECT p_partkey, 'entity_' || sha1('asset:' || lower(trim(p_name))) AS entity_id, 'rel_' || sha1('a:' || lower(p_brand) || ':' || p_name) AS edge_id,
'doc_' || sha1('document:' || p_brand || ':' || p_name) AS document_id, 'corpus_' || sha1('corpus:' || p_brand) AS corpus_id, 'entity_' || sha1('self:' || p_brand) AS self_id FROM part"""
)
def stable_ids(g):
    brand, name = F.col("p_brand"), F.col("p_name")
    return g.base("part").select(
        "p_partkey", ids.entity_id(F.lit("asset"), name).alias("entity_id"), ids.edge_id(F.lit("a"), F.lower(brand), name).alias("edge_id"),
        ids.document_id(brand, name).alias("document_id"), ids.corpus_id(brand).alias("corpus_id"), ids.self_id(brand).alias("self_id"),
    )


_RAW_PREDICATE = "(CASE event_id % 4 WHEN 0 THEN ' NEW: ' WHEN 1 THEN 'new:' WHEN 2 THEN '  ' ELSE '' END || upper(event_type) || ' -by User' || CASE event_id % 3 WHEN 0 THEN '' ELSE '  -x' END)"


@register(
    f"""SELECT event_id, lower(regexp_replace(trim(regexp_replace(trim(p), '^[Nn][Ee][Ww]:', '')), '[ -]+', '_', 'g')) AS predicate, upper(trim(p)) LIKE 'NEW:%' AS is_new
FROM (SELECT event_id, {_RAW_PREDICATE} AS p FROM events) t"""
)
def normalized_predicates(g):
    p = F.expr(_RAW_PREDICATE)
    return g.base("events").select("event_id", ids.normalized_predicate(p).alias("predicate"), ids.is_new_predicate(p).alias("is_new"))


@register("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hashes(g):
    return g.base("documents").where("text IS NOT NULL").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@register(
    """SELECT uuid, regexp_full_match(uuid, '(entity|rel)_[0-9a-f]{40}') AS of_uuid, regexp_full_match(content, '(entity|rel)_[0-9a-f]{40}') AS of_content FROM nodes""",
    "nodes",
)
def generated_id_flags(g):
    return g.nodes.select("uuid", ids.is_generated_id(F.col("uuid")).alias("of_uuid"), ids.is_generated_id(F.col("content")).alias("of_content"))


_TERM = "CASE k % 5 WHEN 0 THEN ' Unknown ' WHEN 1 THEN upper(node_type) WHEN 2 THEN 'N/A' ELSE content END"


@register(
    f"SELECT uuid, lower(trim({_TERM})) IN ('generic', 'unknown', 'none', 'null', 'n/a', 'na', 'unspecified') OR lower(trim({_TERM})) = node_type AS is_placeholder FROM nodes",
    "nodes",
)
def placeholder_flags(g):
    return g.nodes.select("uuid", ids.is_placeholder(F.expr(_TERM), F.col("node_type")).alias("is_placeholder"))


_STARTS = " OR ".join(f"starts_with(q, '{s}')" for s in text.QUESTION_STARTS)


@register(
    f"""SELECT conv_id, turn, n <= 2 AS is_broad, q <> '' AND (contains(q, '?') OR {_STARTS}) AS is_question FROM (
SELECT conv_id, turn, lower(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13))) AS q, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM conversations) t"""
)
def query_modes(g):
    t = F.col("text")
    return g.base("conversations").select("conv_id", "turn", text.is_broad_query(t).alias("is_broad"), text.is_question(t).alias("is_question"))


@register("SELECT uuid, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM logs", "logs")
def metadata_field(g):
    return g.logs.select("uuid", F.get_json_object("metadata", "$.k").cast("long").alias("k"))


# Vector search


def _knn_sql(table: str, join: str, k: int, where: str = "true") -> str:
    return f"""SELECT uuid, distance FROM (SELECT t.uuid, round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), {V0}), 6) AS distance
FROM {table} t JOIN embeddings v ON v.vec_id = {join} WHERE {where}) s ORDER BY distance, uuid LIMIT {k}"""


SIZE = "(SELECT count(*) FROM embeddings)"


def _vector_nodes(g):
    return g.with_vectors(g.nodes, "vec_id")


def _vector_edges(g):
    return g.with_vectors(g.edges, "first_j")


def _vector_logs(g):
    return g.with_vectors(g.logs, "k").withColumn("n_obs", F.lit(0))


def _q(g):
    return scoring.vector(g.query_vector(0))


@register(_knn_sql("nodes", "t.vec_id", 50), "nodes")
def knn_nodes(g):
    return search.knn(_vector_nodes(g), _q(g), 50).select("uuid", "distance")


@register(_knn_sql("edges", f"t.first_j % {SIZE}", 50), "edges")
def knn_edges(g):
    return search.knn(_vector_edges(g), _q(g), 50).select("uuid", "distance")


def _search_sql(table: str, join: str, where: str, life: str, limit: int, least: float, now: str, updated: str, observed: str) -> str:
    pool = min(max(5 * limit, 1), 200)
    age = f"greatest(coalesce(date_diff('microsecond', {updated}, TIMESTAMP '{now}') / 86400000000.0, 0.0), 0.0)"
    return f"""SELECT uuid, round(CASE WHEN f > 0 THEN distance / f ELSE distance END, 6) AS effective FROM (
SELECT uuid, weight, distance, pow(0.5, {age} / {life}) * (1 + 0.05 * least({observed}, 50)) AS f FROM (
SELECT t.*, round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), {V0}), 6) AS distance
FROM {table} t JOIN embeddings v ON v.vec_id = {join} WHERE {where} ORDER BY distance, t.uuid LIMIT {pool}) p) s
WHERE weight > 0 AND weight >= {least} ORDER BY effective, uuid LIMIT {limit}"""


_NODE_LIFE = "365.0"


@register(_search_sql("nodes", "t.vec_id", "t.user_id = 'global' AND t.node_type <> 'log'", _NODE_LIFE, 40, 0, NODES_NOW, "updated_at", "n_obs"), "nodes")
def search_nodes_decayed(g):
    return search.search_nodes(_vector_nodes(g), _q(g), NODES_NOW, limit=40).select("uuid", "effective")


@register(_search_sql("edges", f"t.first_j % {SIZE}", "t.user_id = 'global'", "90.0", 20, 0, NODES_NOW, "CAST(NULL AS TIMESTAMP)", "n_obs"), "edges")
def search_edges_decayed(g):
    return search.search_edges(_vector_edges(g), _q(g), NODES_NOW, limit=20).select("uuid", "effective")


@register(_search_sql("nodes", "t.vec_id", "t.user_id = 'global' AND t.node_type IN ('person', 'asset')", _NODE_LIFE, 30, 0.5, NODES_NOW, "updated_at", "n_obs"), "nodes")
def search_min_significance(g):
    return search.search_nodes(_vector_nodes(g), _q(g), NODES_NOW, node_types=["person", "asset"], limit=30, min_significance=0.5).select("uuid", "effective")


@register(_search_sql("logs", f"t.k % {SIZE}", "t.user_id = 'user_7' AND t.domain = 'click' AND t.node_type = 'log'", "30.0", 10, 0, LOGS_NOW, "updated_at", "0"), "logs")
def search_domain_filter(g):
    return search.search_nodes(_vector_logs(g), _q(g), LOGS_NOW, user_id="user_7", domain="click", node_types=["log"], limit=10).select("uuid", "effective")


_FOUND = [
    _search_sql("nodes", "t.vec_id", "t.user_id = 'global' AND t.node_type <> 'log'", _NODE_LIFE, 15, 0, NODES_NOW, "updated_at", "n_obs"),
    _search_sql("edges", f"t.first_j % {SIZE}", "t.user_id = 'global'", "90.0", 15, 0, NODES_NOW, "CAST(NULL AS TIMESTAMP)", "n_obs"),
]


@register(f"SELECT *, count(*) OVER () AS count FROM (SELECT 'node' AS kind, uuid, effective FROM ({_FOUND[0]}) a UNION ALL SELECT 'edge', uuid, effective FROM ({_FOUND[1]}) b) r", "nodes", "edges")
def search_counted(g):
    return search.counted(*search.search(_vector_nodes(g), _vector_edges(g), _q(g), NODES_NOW, limit=15))


_ASKED = f"""asked AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 0 THEN 'other' ELSE 'global' END AS user_id, CAST(v.embedding AS DOUBLE[]) AS q, 1 + s_suppkey % 23 AS lim,
CASE s_suppkey % 3 WHEN 1 THEN ['person', 'asset'] WHEN 2 THEN ['log'] END AS types, CASE s_suppkey % 2 WHEN 0 THEN 0.0 ELSE 0.5 END AS least
FROM supplier JOIN embeddings v ON v.vec_id = s_suppkey % {SIZE})"""


def _asked(g):
    """A search for each supplier: two tenants, several limits, types and least weights."""
    s = g.numbered(g.base("supplier").select("s_suppkey"), "s_suppkey")
    k = F.col("s_suppkey")
    types = F.when(k % 3 == 1, F.array(F.lit("person"), F.lit("asset"))).when(k % 3 == 2, F.array(F.lit("log")))
    return s.select(
        k.alias("request_id"), F.when(k % 4 == 0, "other").otherwise("global").alias("user_id"), "vec_id", F.lit(None).cast("string").alias("domain"), types.alias("node_types"),
        (1 + k % 23).cast("int").alias("limit"), F.when(k % 2 == 0, 0.0).otherwise(0.5).alias("min_significance"),
    )


def _asked_sql(table: str, at: str, where: str, life: str, updated: str) -> str:
    age = f"greatest(coalesce(date_diff('microsecond', {updated}, TIMESTAMP '{NODES_NOW}') / 86400000000.0, 0.0), 0.0)"
    return f"""WITH {_ASKED}, d AS (SELECT r.request_id, r.lim, r.least, t.*, round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), r.q), 6) AS distance
FROM asked r JOIN {table} t ON t.user_id = r.user_id AND {where} JOIN embeddings v ON v.vec_id = {at}),
p AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY distance, uuid) <= least(greatest(5 * lim, 1), 200)),
e AS (SELECT request_id, lim, uuid, round(CASE WHEN f > 0 THEN distance / f ELSE distance END, 6) AS effective
      FROM (SELECT *, pow(0.5, {age} / {life}) * (1 + 0.05 * least(n_obs, 50)) AS f FROM p WHERE weight > 0 AND (least <= 0 OR weight >= least)) x)
SELECT request_id, uuid, effective, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY effective, uuid) AS place FROM e) y WHERE place <= lim"""


@register(
    _asked_sql("nodes", "t.vec_id", "CASE WHEN r.types IS NULL THEN t.node_type <> 'log' ELSE list_contains(r.types, t.node_type) END", "CASE node_type WHEN 'log' THEN 30.0 ELSE 365.0 END", "updated_at"), "nodes"
)
def search_requests(g):
    return bulk.search_requests(_asked(g), g.nodes, NODES_NOW, vectors=g.vectors)


@register(_asked_sql("edges", f"t.first_j % {SIZE}", "true", "90.0", "CAST(NULL AS TIMESTAMP)"), "edges")
def search_edge_requests(g):
    return bulk.search_edge_requests(_asked(g), g.numbered(g.edges, "first_j"), NODES_NOW, vectors=g.vectors)


# Traversal


@register(
    """SELECT DISTINCT uuid FROM (
SELECT e.uuid, row_number() OVER (PARTITION BY subject_uuid ORDER BY e.uuid) AS r FROM edges e JOIN nodes n ON n.uuid = subject_uuid WHERE node_type = 'place' AND e.user_id = 'global'
UNION ALL
SELECT e.uuid, row_number() OVER (PARTITION BY object_uuid ORDER BY e.uuid) AS r FROM edges e JOIN nodes n ON n.uuid = object_uuid WHERE node_type = 'place' AND e.user_id = 'global') t WHERE r <= 50""",
    "edges",
    "nodes",
)
def adjacency_capped(g):
    places = g.nodes.where("node_type = 'place'").select("uuid")
    return traverse.incident_edges(g.edges, places, "global").select("uuid").distinct()


def _expanded(graph: traverse.Subgraph) -> DataFrame:
    return graph.nodes.select(F.lit("node").alias("kind"), "uuid").unionByName(graph.edges.select(F.lit("edge").alias("kind"), "uuid"))


def _expand(g, seeds, with_query=False, **how):
    return traverse.expand(g.by_key.nodes, g.by_key, seeds, _q(g) if with_query else None, **how)


@register(expand_sql([NATION_0], hops=1, k=20), "nodes", "edges")
def expand_1hop(g):
    return _expanded(_expand(g, seed(g, "nation_0"), hops=1))


@register(expand_sql([NATION_0], hops=2, k=20), "nodes", "edges")
def expand_2hop(g):
    return _expanded(_expand(g, seed(g, "nation_0"), hops=2))


@register(expand_sql([NATION_0, "'entity_' || sha1('place:nation_1')"], hops=2, k=15, query=V0), "nodes", "edges")
def expand_pruned_by_query(g):
    return _expanded(_expand(g, seed(g, "nation_0", "nation_1"), True, hops=2, limit_per_hop=15))


@register(expand_sql([ME, NATION_0], hops=2, k=5, floor=30, query=V0, me=ME), "nodes", "edges")
def expand_self_floor(g):
    return _expanded(_expand(g, seed(g, "SELF", "nation_0"), True, hops=2, limit_per_hop=5, self_floor=30))


@register(expand_sql([NATION_0], hops=2, k=20, source="BUILDING"), "nodes", "edges")
def expand_source_filter(g):
    return _expanded(_expand(g, seed(g, "nation_0"), hops=2, source="BUILDING"))


@register(expand_sql(["'entity_' || sha1('place:nation_5')", "'entity_' || sha1('place:nation_6')"], hops=2, k=20), "nodes", "edges")
def expand_tombstones(g):
    return _expanded(_expand(g, seed(g, "nation_5", "nation_6"), hops=2))


_GRAPH_ASKED = f"""asked AS (SELECT s_suppkey AS rid, CASE s_suppkey % 4 WHEN 0 THEN 'other' ELSE 'global' END AS usr, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' END AS src,
CASE WHEN s_suppkey % 2 = 0 THEN CAST(v.embedding AS DOUBLE[]) END AS q FROM supplier JOIN embeddings v ON v.vec_id = s_suppkey % {SIZE}),
start AS (SELECT s_suppkey AS rid, 'entity_' || sha1('organization:' || lower(trim(s_name))) AS uuid FROM supplier
UNION SELECT s_suppkey, 'entity_' || sha1('place:' || lower(trim(n_name))) FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT s_suppkey, {ME} FROM supplier WHERE s_suppkey % 5 = 0)"""


@register(expand_requests_sql(_GRAPH_ASKED, hops=2, k=4, floor=6, me=ME), "nodes", "edges")
def expand_requests(g):
    """An expansion for each supplier, from itself, its nation and sometimes SELF, with two tenants, sources and queries."""
    k = F.col("s_suppkey")
    s = g.base("supplier").join(g.base("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    asked = g.vector_named(s, "s_suppkey").select(
        k.alias("request_id"), F.when(k % 4 == 0, "other").otherwise("global").alias("user_id"), F.when(k % 2 == 0, F.col("vec_id")).alias("vec_id"), F.when(k % 3 == 0, "BUILDING").alias("source")
    )
    start = F.array(ids.entity_id(F.lit("organization"), F.col("s_name")), ids.entity_id(F.lit("place"), F.col("n_name")), F.when(k % 5 == 0, ids.self_id(F.lit("global"))))
    seeds = s.select(k.alias("request_id"), F.explode(F.array_compact(start)).alias("uuid"))
    done = bulk.expand_requests(asked, seeds, g.store.nodes, g.store, hops=2, limit_per_hop=4, self_floor=6, vectors=g.vectors)
    return done.nodes.select(F.lit("node").alias("kind"), "request_id", "uuid").unionByName(done.edges.select(F.lit("edge").alias("kind"), "request_id", "uuid"))


@register(
    """WITH b AS (SELECT * FROM edges WHERE predicate IN ('lives_in', 'is_part_of')), x AS (SELECT * FROM edges WHERE predicate IN ('is_part_of', 'located_at'))
SELECT 'edge' AS kind, uuid FROM b UNION ALL
SELECT 'edge', min(uuid) FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.subject_uuid = x.subject_uuid AND b.predicate = x.predicate AND b.object_uuid = x.object_uuid)
GROUP BY subject_uuid, predicate, object_uuid
UNION ALL SELECT 'node', uuid FROM nodes WHERE node_type IN ('place', 'organization', 'person')""",
    "edges",
    "nodes",
)
def merge_graphs(g):
    part = lambda types, predicates: traverse.Subgraph(g.nodes.where(F.col("node_type").isin(types)), g.edges.where(F.col("predicate").isin(predicates)))
    return _expanded(traverse.merge(part(["place", "person"], ["lives_in", "is_part_of"]), part(["place", "organization"], ["is_part_of", "located_at"])))


_LABEL = "coalesce(substr({0}.content, 1, 40), substr(e.{1}, 1, 8))"


@register(
    f"""SELECT e.uuid, {_LABEL.format('s', 'subject_uuid')} AS subject_label, {_LABEL.format('o', 'object_uuid')} AS object_label FROM edges e
LEFT JOIN nodes s ON s.uuid = e.subject_uuid AND s.node_type <> 'asset' LEFT JOIN nodes o ON o.uuid = e.object_uuid AND o.node_type <> 'asset'""",
    "edges",
    "nodes",
)
def edge_labels(g):
    return traverse.labels(g.edges, g.nodes.where("node_type <> 'asset'")).select("uuid", "subject_label", "object_label")


def _with_journal(g):
    said = F.array_sort(F.collect_list(F.struct("pos", "log_uuid")))
    return g.mentions.groupBy("entity_uuid").agg(F.transform(said, lambda x: x["log_uuid"]).alias("journal_entry_ids")).withColumnRenamed("entity_uuid", "uuid")


_SOURCES = """SELECT m.entity_uuid, m.log_uuid, CAST(m.pos - greatest(c.n - 2, 0) AS BIGINT) AS pos, substr(l.content, 1, 250) AS snippet FROM mentions m
JOIN (SELECT entity_uuid, count(*) AS n FROM mentions GROUP BY 1) c USING (entity_uuid) JOIN logs l ON l.uuid = m.log_uuid WHERE m.pos > c.n - 2"""


@register(_SOURCES, "mentions", "logs")
def source_logs(g):
    return enrich.source_logs(_with_journal(g), g.logs, total=None).withColumn("pos", F.col("pos").cast("long"))


@register(
    f"""WITH s AS ({_SOURCES}), first AS (SELECT log_uuid, min(entity_uuid || CAST(pos AS VARCHAR)) AS place FROM s GROUP BY 1 ORDER BY place, log_uuid LIMIT 30)
SELECT s.* FROM s JOIN first USING (log_uuid)""",
    "mentions",
    "logs",
)
def source_logs_capped(g):
    return enrich.source_logs(_with_journal(g), g.logs).withColumn("pos", F.col("pos").cast("long"))


# Resolution


@register(
    """WITH f AS (SELECT uuid AS fact_uuid, user_id, subject_uuid FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, subject_uuid ORDER BY first_j DESC, uuid) AS rank FROM edges)
SELECT fact_uuid, r.uuid AS candidate_uuid, rank FROM f JOIN r USING (user_id, subject_uuid) WHERE rank <= 10 AND fact_uuid <> r.uuid AND substr(r.uuid, 7, 1) <> '0'""",
    "edges",
)
def supersede_candidates(g):
    facts = g.edges.withColumn("updated_at", F.col("first_j")).withColumn("content", F.when(F.substring("uuid", 7, 1) == "0", F.lit("  ")).otherwise(F.col("predicate")))
    return resolve.supersede_candidates(g.edges, facts).withColumn("rank", F.col("rank").cast("long"))


def _part_mentions(g):
    return g.base("part").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("name"), F.lit("asset").alias("node_type"), F.col("p_partkey").alias("k"))


@register(
    """SELECT p_partkey AS mention_id, m.by_name, i.uuid AS by_id FROM part LEFT JOIN (SELECT name_key, min(uuid) AS by_name FROM nodes WHERE node_type = 'asset' GROUP BY 1) m ON m.name_key = lower(p_name)
LEFT JOIN nodes i ON i.uuid = 'entity_' || sha1('asset:' || lower(trim(p_name)))""",
    "nodes",
)
def entity_exact_resolution(g):
    return resolve.exact_matches(_part_mentions(g), g.nodes).select("mention_id", "by_name", "by_id")


_NEAR = f"""SELECT mention_id, min(struct_pack(d := d, u := uuid)) AS b FROM (
SELECT p.p_partkey AS mention_id, n.uuid, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d
FROM part p JOIN embeddings a ON a.vec_id = p.p_partkey % {SIZE} JOIN nodes n ON n.node_type = 'organization' JOIN embeddings b ON b.vec_id = n.vec_id) t WHERE d <= 0.5 GROUP BY 1"""


@register(f"SELECT mention_id, b.u AS near_uuid, b.d AS distance FROM ({_NEAR}) s", "nodes")
def entity_nearest_match(g):
    m = g.vector_named(_part_mentions(g), "k").withColumn("node_type", F.lit("organization"))
    return resolve.nearest(m, g.node_names.where("node_type = 'organization'"), threshold=0.5, vectors=g.vectors)


_CASCADE_NAME = "CASE p_partkey % 11 WHEN 0 THEN ' self ' WHEN 1 THEN '  ' WHEN 2 THEN 'entity_' || sha1('organization:supplier ' || CAST(p_partkey AS STRING)) WHEN 3 THEN 'entity_' || sha1('place:nation_' || CAST(p_partkey % 25 AS STRING)) ELSE p_name END"


@register(
    f"""WITH m AS (SELECT p_partkey, trim({_CASCADE_NAME}) AS name FROM part), t AS (SELECT *, upper(name) = 'SELF' AS me, regexp_full_match(name, '(entity|rel)_[0-9a-f]{{40}}') AS strict FROM m)
SELECT p_partkey AS mention_id,
CASE WHEN name = '' THEN NULL WHEN me THEN {ME} WHEN strict THEN st.uuid ELSE coalesce(s.b.u, nk.u, 'entity_' || sha1('organization:' || lower(name))) END AS uuid,
CASE WHEN name = '' THEN 'empty' WHEN me THEN 'self' WHEN strict AND st.uuid IS NULL THEN 'missing' WHEN strict THEN 'strict'
     WHEN s.b.u IS NOT NULL THEN 'vector' WHEN nk.u IS NOT NULL THEN 'name' WHEN i.uuid IS NOT NULL THEN 'id' ELSE 'new' END AS how
FROM t LEFT JOIN ({_NEAR}) s ON s.mention_id = p_partkey LEFT JOIN (SELECT name_key, min(uuid) AS u FROM nodes WHERE node_type = 'organization' GROUP BY 1) nk ON nk.name_key = lower(name)
LEFT JOIN nodes i ON i.uuid = 'entity_' || sha1('organization:' || lower(name)) LEFT JOIN nodes st ON st.uuid = name""",
    "nodes",
)
def entity_cascade(g):
    m = g.vector_named(_part_mentions(g), "k").withColumn("node_type", F.lit("organization"))
    m = m.withColumn("name", F.expr(_CASCADE_NAME.replace("p_partkey", "mention_id").replace("p_name", "name")))
    return resolve.resolve(m, g.node_names, threshold=0.5, vectors=g.vectors)


@register(None)
def greedy_resolution(g):
    m = g.with_vectors(_part_mentions(g), "k").withColumn("pos", F.col("mention_id"))
    return resolve.greedy_resolution(m)


_RAW_TERM = "CASE k % 7 WHEN 0 THEN 'self' WHEN 1 THEN '  ' WHEN 2 THEN 'None' WHEN 3 THEN uuid WHEN 4 THEN 'entity_' || sha1(content) WHEN 5 THEN ' ' || content || ' ' ELSE upper(node_type) END"


@register(
    f"""SELECT t.uuid AS term_id, CASE WHEN upper(b) = 'SELF' THEN 'Me' WHEN bad THEN NULL WHEN gen THEN r.content ELSE b END AS text,
CASE WHEN upper(b) = 'SELF' THEN 'entity_' || sha1('self:' || t.user_id) WHEN bad THEN NULL WHEN gen THEN r.uuid END AS uuid, bad AS rejected FROM (
SELECT s.*, upper(b) <> 'SELF' AND (b = '' OR lower(b) IN ('generic', 'unknown', 'none', 'null', 'n/a', 'na', 'unspecified') OR lower(b) = node_type OR (gen AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.uuid = s.b))) AS bad
FROM (SELECT uuid, node_type, user_id, trim({_RAW_TERM}) AS b, regexp_full_match(trim({_RAW_TERM}), '(entity|rel)_[0-9a-f]{{40}}') AS gen FROM nodes) s) t LEFT JOIN nodes r ON r.uuid = t.b""",
    "nodes",
)
def term_resolution(g):
    terms = g.nodes.select(F.col("uuid").alias("term_id"), F.expr(_RAW_TERM).alias("term"), "node_type", "user_id")
    return resolve.resolve_terms(terms, g.nodes).select("term_id", "text", "uuid", "rejected")


# Corpora

_PARAGRAPHS = """p AS (SELECT uuid, CAST(i AS BIGINT) AS i, x AS para, len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) AS n FROM (
SELECT uuid, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT uuid, list_filter(list_transform(regexp_split_to_array(content, '\\n\\n+'), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')), lambda y: y <> '') AS l FROM corpus_docs WHERE content IS NOT NULL) a) b),
f AS (SELECT uuid, i, para, n, CAST(0 AS BIGINT) AS chunk, CAST(n AS BIGINT) AS size, i AS start FROM p WHERE i = 1
UNION ALL
SELECT p.uuid, p.i, p.para, p.n, f.chunk + CASE WHEN f.size + p.n > {0} THEN 1 ELSE 0 END, CASE WHEN f.size + p.n > {0} THEN f.n + p.n ELSE f.size + p.n END, CASE WHEN f.size + p.n > {0} THEN f.i ELSE f.start END
FROM f JOIN p ON p.uuid = f.uuid AND p.i = f.i + 1),
b AS (SELECT uuid, chunk, min(start) AS lo, max(i) AS hi FROM f GROUP BY 1, 2),
cut AS (SELECT b.uuid AS document_id, chunk AS chunk_index, string_agg(p.para, chr(10) || chr(10) ORDER BY p.i) AS content FROM b JOIN p ON p.uuid = b.uuid AND p.i BETWEEN b.lo AND b.hi GROUP BY 1, 2)"""


def _cut(g):
    return corpus.chunks(g.corpus_docs.where("content IS NOT NULL").select("uuid", "filename", "content"), 200).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("WITH RECURSIVE " + _PARAGRAPHS.format(200) + " SELECT document_id, chunk_index, sha256(content) AS content_hash FROM cut", "corpus_docs")
def chunk_prose(g):
    return _cut(g).select("document_id", "chunk_index", ids.content_hash(F.col("content")).alias("content_hash"))


def _chunk_nodes(g):
    return corpus.chunk_nodes(_cut(g), g.corpus_docs)


_CHUNK_ID = "'chunk_' || sha1(document_id || ':' || CAST(chunk_index AS VARCHAR))"


@register(
    "WITH RECURSIVE " + _PARAGRAPHS.format(200) + f""", n AS (SELECT document_id, chunk_index, {_CHUNK_ID} AS uuid FROM cut)
SELECT predicate, subject_uuid, object_uuid, 'rel_' || sha1(subject_uuid || ':' || predicate || ':' || object_uuid) AS uuid FROM (
SELECT 'has_chunk' AS predicate, document_id AS subject_uuid, uuid AS object_uuid FROM n
UNION ALL SELECT 'next_chunk', a.uuid, b.uuid FROM n a JOIN n b ON a.document_id = b.document_id AND b.chunk_index = a.chunk_index + 1
UNION ALL SELECT 'contains', corpus_uuid, uuid FROM corpus_docs) e""",
    "corpus_docs",
)
def corpus_bridge_edges(g):
    n = _chunk_nodes(g)
    return corpus.has_chunk(n).unionByName(corpus.next_chunk(n)).unionByName(corpus.contains(g.corpus_docs)).select("predicate", "subject_uuid", "object_uuid", "uuid")


_NAMES = "SELECT uuid AS document_id, 'entity_' || sha1(lang) AS entity_uuid, CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'Der' WHEN 'fr' THEN 'la' ELSE 'Que' END AS name FROM corpus_docs UNION ALL SELECT uuid, 'entity_' || sha1('a.b'), 'a\\.b' FROM corpus_docs"


@register(
    "WITH RECURSIVE " + _PARAGRAPHS.format(200) + f""" SELECT DISTINCT n.entity_uuid AS subject_uuid, {_CHUNK_ID} AS object_uuid FROM ({_NAMES}) n
JOIN cut USING (document_id) WHERE regexp_matches(content, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || name || '([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')""",
    "corpus_docs",
)
def mentioned_in(g):
    name = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "Der").when(F.col("lang") == "fr", "la").otherwise("Que")
    names = g.corpus_docs.select(F.col("uuid").alias("document_id"), F.concat(F.lit("entity_"), F.sha1("lang")).alias("entity_uuid"), name.alias("name"))
    names = names.unionByName(g.corpus_docs.select(F.col("uuid").alias("document_id"), F.concat(F.lit("entity_"), F.sha1(F.lit("a.b"))).alias("entity_uuid"), F.lit("a.b").alias("name")))
    return corpus.mentioned_in(names, _chunk_nodes(g)).select("subject_uuid", "object_uuid")


_STORED = "SELECT uuid, CASE WHEN doc_id % 3 = 0 THEN sha256(content || 'x') ELSE sha256(content) END AS content_hash FROM corpus_docs WHERE doc_id % 4 <> 1 AND content IS NOT NULL"


@register(
    f"""SELECT d.uuid, d.filename, sha256(d.content) AS content_hash, CASE WHEN s.uuid IS NULL THEN 'new' WHEN s.content_hash = sha256(d.content) THEN 'unchanged' ELSE 'changed' END AS status
FROM corpus_docs d LEFT JOIN ({_STORED}) s ON s.uuid = d.uuid WHERE d.content IS NOT NULL""",
    "corpus_docs",
)
def document_classification(g):
    docs = g.corpus_docs.where("content IS NOT NULL")
    stored = docs.where("doc_id % 4 <> 1").select("uuid", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.sha2("content", 256)).alias("content_hash"))
    return corpus.classify(docs.select("corpus_id", "filename", "content"), stored).select("uuid", "filename", "content_hash", "status")


@register(
    """SELECT 'corpus_' || sha1('corpus:' || corpus_id) AS uuid, 'Corpus ''' || corpus_id || ''': ' || string_agg(filename, ', ' ORDER BY doc_id) AS content, count(*) AS file_count FROM corpus_docs GROUP BY corpus_id""",
    "corpus_docs",
)
def corpus_hubs(g):
    hubs = corpus.corpus_nodes(g.corpus_docs.withColumn("pos", F.col("doc_id")))
    return hubs.select("uuid", "content", F.get_json_object("metadata", "$.file_count").cast("long").alias("file_count"))


@register(
    """SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS completed, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0) AS failed,
count(*) FILTER (WHERE doc_id % 5 <> 0) >= count(*) AS is_complete FROM corpus_docs""",
    "corpus_docs",
)
def corpus_status(g):
    done = F.when(F.col("doc_id") % 5 != 0, F.lit("2024-01-02T00:00:00+00:00"))
    nodes = g.corpus_docs.select("uuid", done.alias("pipeline_done_at"), F.when(F.col("doc_id") % 7 == 0, F.lit("failed")).alias("pipeline_error"))
    return corpus.status(g.corpus_docs.select("uuid"), nodes, "2024-01-01T00:00:00+00:00")


@register(
    "WITH RECURSIVE " + _PARAGRAPHS.format(200) + f""" SELECT {_CHUNK_ID} AS uuid, CASE WHEN doc_id % 2 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS weight
FROM cut JOIN corpus_docs d ON d.uuid = document_id""",
    "corpus_docs",
)
def chunk_tombstones(g):
    gone = g.corpus_docs.where("doc_id % 2 = 0").select("uuid")
    return corpus.tombstone_chunks(_chunk_nodes(g), gone).select("uuid", "weight")


# State


@register(
    """WITH o AS (SELECT l_partkey AS k, 'log_' || CAST(l_orderkey AS VARCHAR) AS j, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2)
SELECT 'entity_' || CAST(k AS VARCHAR) AS uuid, string_agg(j, ',' ORDER BY seq) AS journal, count(*) AS n FROM o GROUP BY k"""
)
def journal_fold(g):
    rows = g.base("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), F.concat(F.lit("entity_"), F.col("l_partkey").cast("string")).alias("uuid"), F.lit("create").alias("op"),
        F.array(F.concat(F.lit("log_"), F.col("l_orderkey").cast("string"))).alias("journal_entry_ids"),
    )
    return changelog.fold(rows).select("uuid", F.array_join("journal_entry_ids", ",").alias("journal"), F.size("journal_entry_ids").cast("long").alias("n"))


@register(
    """SELECT 'entity_' || CAST(user_id AS VARCHAR) AS uuid, min_by(event_type, event_id) AS domain, max_by(event_type, event_id) AS content,
CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS weight FROM events GROUP BY 1"""
)
def state_fold(g):
    """Created, touched and tombstoned keys: identity keeps its first value, content its last, and dead stays dead."""
    e = g.base("events").withColumn("uuid", F.concat(F.lit("entity_"), F.col("user_id").cast("string")))
    created = e.select("uuid").distinct().select(F.lit(-1).cast("long").alias("seq"), "uuid", F.lit("create").alias("op"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("content"), F.lit(0.8).alias("weight"))
    changed = e.select(F.col("event_id").alias("seq"), "uuid", F.lit("touch").alias("op"), F.col("event_type").alias("domain"), F.col("event_type").alias("content"), F.when(F.col("event_type") == "error", F.lit(0.0)).alias("weight"))
    return changelog.fold(created.unionByName(changed)).select("uuid", "domain", "content", "weight")


def _journaled(g):
    """Mentions as changes of a keyed log, compacted after the first twenty of each entity; other entities come later."""
    log = KeyedLog(g.spark, new_path(g.spark, "journal-log"), buckets=8)
    kind = F.when(F.col("entity_uuid") < "entity_8", "person").otherwise("event")
    rows = g.mentions.select(F.col("pos").cast("long").alias("seq"), F.col("entity_uuid").alias("uuid"), F.lit("create").alias("op"), kind.alias("node_type"), F.array("log_uuid").alias("journal_entry_ids"))
    early = (F.col("seq") <= 20) & (F.col("uuid") < "entity_c")
    log.append(rows.where(early))
    log.compact()
    log.append(rows.where(~early))
    return log


@register(
    "SELECT m.entity_uuid AS uuid, m.log_uuid AS log_id, CAST(m.pos - greatest(c.n - 2, 0) AS INT) AS place FROM mentions m JOIN (SELECT entity_uuid, count(*) AS n FROM mentions GROUP BY 1) c USING (entity_uuid) WHERE m.pos > c.n - 2",
    "mentions",
)
def journal_last_entries(g):
    """The last two of each journal from the journal table, by a group limit."""
    return _journaled(g).last_entries().select("uuid", "log_id", F.col("place").cast("int").alias("place"))


@register("SELECT CASE WHEN entity_uuid < 'entity_8' THEN 'person' ELSE 'event' END AS node_type, count(DISTINCT entity_uuid) AS n FROM mentions GROUP BY 1", "mentions")
def stats_kept_up_to_date(g):
    """Counts stored at the compaction, with what the tail has created."""
    return _journaled(g).counts("node_type").select(F.col("value").alias("node_type"), "n")


# Parsers of model answers

_ANSWER = "'status: OK' || chr(10) || 'Triples:' || chr(10) || c_name || ' | Lives In | ' || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' | person | place' WHEN 1 THEN ' | x' ELSE '' END || chr(10) || 'a | | b' || chr(10) || 'SELF | NEW:met | ' || c_name"


@register(
    """SELECT c_custkey, 'ok' AS status, c_name AS subject, 'Lives In' AS predicate, c_mktsegment AS object, CASE c_custkey % 3 WHEN 0 THEN 'person' ELSE 'generic' END AS subject_type, CASE c_custkey % 3 WHEN 0 THEN 'place' ELSE 'generic' END AS object_type
FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, 'ok', 'SELF', 'NEW:met', c_name, 'generic', 'generic' FROM customer"""
)
def refinery_parse(g):
    a = F.expr(_ANSWER)
    return g.base("customer").select("c_custkey", text.refinery_status(a).alias("status"), F.inline(text.refinery_triples(a)))


_GAPS = "CASE c_custkey % 5 WHEN 0 THEN 'None.' WHEN 1 THEN c_name || ',' || c_name ELSE '- ' || c_name || '; none' || chr(10) || '2) ' || c_mktsegment || ' .,' || c_name || chr(10) || '* Nation ' || CAST(c_nationkey AS STRING) || ', rest' END"


@register("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE c_name || '|' || c_mktsegment || '|Nation ' || CAST(c_nationkey AS STRING) END AS queries FROM customer")
def gap_queries(g):
    return g.base("customer").select("c_custkey", F.array_join(text.gap_queries(F.expr(_GAPS)), "|").alias("queries"))


_LINES = "CASE c_custkey % 4 WHEN 0 THEN chr(10) WHEN 1 THEN '* only ' || c_name ELSE '  - 1. ' || c_name || chr(10) || chr(10) || '• ' || c_mktsegment || chr(10) || '2. last' || chr(10) || 'over' END"


@register("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'only ' || c_name ELSE c_name || '|' || c_mktsegment || '|last' END AS statements FROM customer")
def statement_parse(g):
    return g.base("customer").select("c_custkey", F.array_join(text.statements(F.expr(_LINES)), "|").alias("statements"))


@register("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'lives_in' ELSE 'resides_at' END AS predicate FROM customer")
def predicate_gate(g):
    answer = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'existing: Lives_In' || chr(10) || 'x' WHEN 1 THEN 'EXISTING: made_up' ELSE 'NEW: approved' END")
    return g.base("customer").select("c_custkey", text.gate_answer(answer, F.array(*map(F.lit, PREDICATES)), F.lit("resides_at")).alias("predicate"))


# Ingest

_FACT = "'status: ok' || chr(10) || 'triples:' || chr(10) || 'SELF | Did | ' || event_type || ' | person | event' || chr(10) || event_type || ' | NEW: seen-by | user ' || CAST(user_id AS STRING) || ' | event | person' || chr(10) || 'unknown | is_a | x'"


def _entries(df, entry_id, user, at, answer):
    return df.select(entry_id.cast("string").alias("entry_id"), F.lit("text").alias("text"), user.alias("user_id"), F.lit("general").alias("domain"), F.lit(None).cast("string").alias("source"), at.alias("at"), F.expr(answer).alias("answer"))


def _user():
    return F.concat(F.lit("user_"), F.col("user_id").cast("string"))


def _ingested(g):
    # every tenth entry states nothing, whatever its triples say
    answer = f"CASE WHEN event_id % 10 = 9 THEN replace({_FACT}, 'status: ok', 'status: None') ELSE {_FACT} END"
    entries = _entries(g.base("events"), F.col("event_id"), _user(), F.col("ts"), answer)
    seen = g.base("events").where("event_type < 'm'").select(ids.entity_id(F.lit("event"), F.col("event_type")).alias("uuid"), F.col("event_type").alias("content"), F.lit("event").alias("node_type")).distinct()
    return ingest.ingest(entries, g.node_keys.select("uuid", "content", "node_type").unionByName(seen), PREDICATES, answer="answer")


_TOLD = """t AS (SELECT 'user_' || CAST(user_id AS VARCHAR) AS u, event_type, user_id, event_id, 'entity_' || sha1('self:user_' || CAST(user_id AS VARCHAR)) AS me, 'entity_' || sha1('event:' || event_type) AS ev,
'entity_' || sha1('person:user ' || CAST(user_id AS VARCHAR)) AS p FROM events WHERE event_id % 10 <> 9)"""


@register(
    f"""WITH {_TOLD}, f AS (SELECT me AS s, 'did' AS p, ev AS o, event_id FROM t UNION ALL SELECT ev, 'seen_by', p, event_id FROM t)
SELECT 'rel_' || sha1(s || ':' || p || ':' || o) AS uuid, s AS subject_uuid, p AS predicate, o AS object_uuid, count(DISTINCT event_id) AS n_obs FROM f GROUP BY s, p, o"""
)
def ingest_edges(g):
    return _ingested(g).edges.select("uuid", "subject_uuid", "predicate", "object_uuid", F.size("journal_entry_ids").cast("long").alias("n_obs"))


@register(
    f"""WITH {_TOLD}, n AS (SELECT event_id, me AS uuid, 'person' AS node_type, 'Me' AS content, false AS existed FROM t
UNION ALL SELECT event_id, ev, 'event', event_type, event_type < 'm' FROM t UNION ALL SELECT event_id, p, 'person', 'user ' || CAST(user_id AS VARCHAR), false FROM t)
SELECT uuid, node_type, content, count(DISTINCT event_id) AS n_obs, existed FROM n GROUP BY 1, 2, 3, 5"""
)
def ingest_nodes(g):
    return _ingested(g).nodes.select("uuid", "node_type", "content", F.size("journal_entry_ids").cast("long").alias("n_obs"), "existed")


@register(f"WITH {_TOLD} SELECT u || ':' || CAST(event_id AS VARCHAR) || ':2' AS triple_id, 'unresolved id or placeholder' AS reason FROM t")
def ingest_rejects(g):
    return _ingested(g).rejected.select("triple_id", "reason")


@register(
    f"""WITH {_TOLD}, o AS (SELECT event_id, me AS id, false AS known FROM t UNION ALL SELECT event_id, ev, event_type < 'm' FROM t UNION ALL SELECT event_id, p, false FROM t),
f AS (SELECT id, arg_min(event_id, (ts, event_id)) AS first FROM o JOIN events USING (event_id) GROUP BY 1)
SELECT CAST(event_id AS VARCHAR) AS entry_id, id, CASE WHEN NOT known AND event_id = first THEN 'created' ELSE 'updated' END AS kind FROM o JOIN f USING (id)
UNION SELECT CAST(event_id AS VARCHAR), 'rel_' || sha1(me || ':did:' || ev), 'fact' FROM t UNION SELECT CAST(event_id AS VARCHAR), 'rel_' || sha1(ev || ':seen_by:' || p), 'fact' FROM t"""
)
def ingest_acknowledgements(g):
    return _ingested(g).acks


_PROPOSED = "'status: ok' || chr(10) || 'triples:' || chr(10) || event_type || CASE event_id % 4 WHEN 0 THEN ' | NEW: resides in | ' WHEN 1 THEN ' | new:Likes | ' WHEN 2 THEN ' | NEW: odd-thing | ' ELSE ' | uses | ' END || 'thing'"


@register(
    """WITH t AS (SELECT DISTINCT event_type, CASE event_id % 4 WHEN 0 THEN 'lives_in' WHEN 1 THEN 'likes' WHEN 2 THEN 'odd_thing' ELSE 'uses' END AS predicate FROM events)
SELECT 'edge' AS kind, 'rel_' || sha1('entity_' || sha1('generic:' || event_type) || ':' || predicate || ':entity_' || sha1('generic:thing')) AS name FROM t
UNION ALL SELECT DISTINCT 'predicate', predicate FROM t WHERE predicate IN ('likes', 'odd_thing')"""
)
def ingest_gated(g):
    """Proposals go to a known predicate, stay where the answer names an unknown one, or are approved."""
    entries = _entries(g.base("events"), F.col("event_id"), F.lit("global"), F.col("ts"), _PROPOSED)
    gate = F.expr("CASE predicate WHEN 'resides_in' THEN 'existing: Lives_In' WHEN 'likes' THEN 'EXISTING: made_up' ELSE 'NEW: approved' END")
    done = ingest.ingest(entries, g.node_keys.select("uuid", "content", "node_type"), PREDICATES, answers={"extract": "answer", "gate": gate})
    return done.edges.select(F.lit("edge").alias("kind"), F.col("uuid").alias("name")).unionByName(done.predicates.select(F.lit("predicate").alias("kind"), "name"))


_WORDED = "CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' jr' ELSE 'new ' || c_name END"


def _angle_vector(k):
    return F.array(F.cos(k * 0.002), F.sin(k * 0.002)).cast("array<double>")


def _worded(g):
    """Customers under other names: by name, by vector, or new; nodes have vectors by their number."""
    answer = f"'status: ok' || chr(10) || 'triples:' || chr(10) || {_WORDED} || ' | knows | thing | person | generic'"
    entries = _entries(g.base("customer"), F.col("c_custkey"), F.lit("global"), F.lit("2024-01-01").cast("timestamp"), answer)
    nodes = g.node_keys.where("node_type = 'person' AND content <> 'Me'").select("uuid", "content", "node_type", F.lower("content").alias("name_key"), _angle_vector(F.col("k")).alias("embedding"))
    embed = lambda c: F.when(c.endswith(" jr"), _angle_vector(F.regexp_extract(c, r"(\d+)", 1).cast("long")))
    collide = F.expr("CASE WHEN try_cast(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) % 2 = 0 THEN 'Update it' ELSE 'insert' END")
    return ingest.ingest(entries, nodes, PREDICATES, answers={"extract": "answer", "collide": collide}, embed=embed, threshold=0.0, collisions=True)


_WORDED_MATCH = """p AS (SELECT c_custkey AS k, c_name, 'entity_' || sha1('person:' || lower(trim(c_name))) AS uuid, [cos(c_custkey * 0.002), sin(c_custkey * 0.002)] AS v FROM customer),
near AS (SELECT m.k, min(n.uuid) AS uuid FROM p m JOIN p n ON round(1 - list_cosine_similarity(m.v, n.v), 6) <= 0 WHERE m.k % 3 = 1 GROUP BY 1)"""


@register(
    f"""WITH {_WORDED_MATCH}
SELECT CAST(p.k AS VARCHAR) AS entry_id, coalesce(near.uuid, CASE p.k % 3 WHEN 0 THEN p.uuid ELSE 'entity_' || sha1('person:new ' || lower(p.c_name)) END) AS uuid,
CASE p.k % 3 WHEN 0 THEN p.c_name WHEN 1 THEN q.c_name ELSE 'new ' || p.c_name END AS content FROM p LEFT JOIN near ON near.k = p.k LEFT JOIN p q ON q.uuid = near.uuid
UNION ALL SELECT CAST(k AS VARCHAR), 'entity_' || sha1('generic:thing'), 'thing' FROM p"""
)
def ingest_resolved(g):
    return _worded(g).named


@register(
    f"""WITH {_WORDED_MATCH}
SELECT near.uuid, arg_max(p.c_name, CAST(p.k AS VARCHAR)) || ' jr' AS content FROM near JOIN p ON p.k = near.k WHERE near.k % 2 = 0 GROUP BY 1"""
)
def ingest_collisions(g):
    return _worded(g).renamed.select("uuid", "content")


@register(
    """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'rel_' || CAST(o_orderkey AS VARCHAR)) AS rank FROM orders),
n AS (SELECT o_custkey, least(count(*), 10) AS n FROM r GROUP BY 1)
SELECT 'rel_' || CAST(o_orderkey AS VARCHAR) AS uuid FROM r JOIN n USING (o_custkey) JOIN customer ON c_custkey = o_custkey WHERE rank = n % 3"""
)
def ingest_superseded(g):
    """A new fact of each customer replaces the first or the second of their newest orders, or none."""
    answer = "'status: ok' || chr(10) || 'triples:' || chr(10) || 'SELF | owns | thing'"
    user = F.concat(F.lit("user_"), F.col("c_custkey").cast("string"))
    entries = _entries(g.base("customer"), F.col("c_custkey"), user, F.lit("2024-01-01").cast("timestamp"), answer)
    owner = F.concat(F.lit("user_"), F.col("o_custkey").cast("string"))
    stored = g.base("orders").select(F.concat(F.lit("rel_"), F.col("o_orderkey").cast("string")).alias("uuid"), owner.alias("user_id"), ids.self_id(owner).alias("subject_uuid"), F.lit("ordered").alias("content"), F.col("o_orderdate").alias("updated_at"))
    said = F.expr("CASE size(facts) % 3 WHEN 1 THEN upper(facts[0].uuid) WHEN 2 THEN ' ' || facts[1].uuid ELSE 'none' END")
    done = ingest.ingest(entries, g.node_keys.select("uuid", "content", "node_type"), PREDICATES, answers={"extract": "answer", "supersede": said}, edges=stored)
    return done.tombstones


_STATED = "'status: ok' || chr(10) || 'triples:' || chr(10) || 'SELF | has_status | state ' || CAST(o_orderkey % 13 AS STRING)"


@register(
    """WITH occ AS (SELECT CAST(o_orderkey AS VARCHAR) AS e, o_custkey AS c, o_orderdate AS told,
  'rel_' || sha1('entity_' || sha1('self:user_' || CAST(o_custkey AS VARCHAR)) || ':has_status:entity_' || sha1('generic:state ' || CAST(o_orderkey % 13 AS VARCHAR))) AS uuid FROM orders),
seen AS (SELECT i.c, i.e, i.uuid AS own, j.uuid, max(j.told) AS told FROM occ i JOIN occ j ON i.c = j.c AND (j.told, j.e) < (i.told, i.e) GROUP BY ALL),
ten AS (SELECT *, row_number() OVER (PARTITION BY c, e ORDER BY told DESC, uuid) AS r FROM seen QUALIFY r <= 10),
others AS (SELECT c, e, list(uuid ORDER BY r) AS u FROM ten WHERE uuid <> own GROUP BY ALL)
SELECT DISTINCT CASE len(u) % 3 WHEN 1 THEN u[1] WHEN 2 THEN u[-1] END AS uuid FROM others WHERE len(u) % 3 > 0"""
)
def ingest_superseded_in_order(g):
    """Orders as statements of one batch: a later one replaces the newest or the tenth newest of its customer's, as they stand then."""
    entries = _entries(g.base("orders"), F.col("o_orderkey"), F.concat(F.lit("user_"), F.col("o_custkey").cast("string")), F.col("o_orderdate").cast("timestamp"), _STATED)
    said = F.expr("CASE size(facts) % 3 WHEN 1 THEN facts[0].uuid WHEN 2 THEN facts[size(facts) - 1].uuid ELSE 'none' END")
    none = g.spark.createDataFrame([], "uuid string, user_id string, subject_uuid string, content string, updated_at timestamp")
    done = ingest.ingest(entries, g.node_keys.select("uuid", "content", "node_type"), PREDICATES, answers={"extract": "answer", "supersede": said}, edges=none)
    return done.tombstones


@register(
    """WITH occ AS (SELECT o_orderkey % 2 AS batch, o_orderkey AS k, o_custkey AS c, o_orderdate AS told,
  'rel_' || sha1('entity_' || sha1('self:user_' || CAST(o_custkey AS VARCHAR)) || ':has_status:entity_' || sha1('generic:state ' || CAST(o_orderkey % 13 AS VARCHAR))) AS uuid FROM orders),
e AS (SELECT c, uuid, count(*) AS n_obs, max(told) AS updated, coalesce(min(told) FILTER (batch = 0), min(told)) AS created FROM occ GROUP BY 1, 2)
SELECT c AS customer, uuid, n_obs, strftime(created, '%Y-%m-%d') AS created, strftime(updated, '%Y-%m-%d') AS updated, row_number() OVER (PARTITION BY c ORDER BY updated DESC, uuid) AS rank FROM e QUALIFY rank <= 3"""
)
def state_after_touch(g):
    """Two batches into keyed logs, compacted between them: times of creation and last touch, and the newest facts by them."""
    nodes, edges = KeyedLog(g.spark, new_path(g.spark, "node-log"), buckets=8, names=True), KeyedLog(g.spark, new_path(g.spark, "edge-log"), key="subject_uuid", buckets=8)
    for batch in (0, 1):
        orders = g.base("orders").where(F.col("o_orderkey") % 2 == batch)
        entries = _entries(orders, F.col("o_orderkey"), F.concat(F.lit("user_"), F.col("o_custkey").cast("string")), F.col("o_orderdate").cast("timestamp"), _STATED)
        done = ingest.ingest(entries, nodes, PREDICATES, answers={"extract": "answer"}, edges=edges)
        ingest_stream.write(done, batch, nodes, edges, done.stored_edges, None)
        if not batch:
            nodes.compact()
            edges.compact()
    customer = F.col("user_id").substr(6, 20).cast("long")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "uuid"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    seen = edges.journal().groupBy("uuid").agg(F.count(F.lit(1)).alias("n_obs"))
    told = edges.state().join(seen, "uuid").select(customer.alias("customer"), "uuid", "n_obs", day("created_at").alias("created"), day("updated_at").alias("updated"), rank.cast("long").alias("rank"))
    return told.where("rank <= 3")


_COINED = "'status: ok' || chr(10) || 'triples:' || chr(10) || event_type || ' | NEW: ' || CASE event_id % 4 WHEN 0 THEN 'enjoys' WHEN 1 THEN 'likes' WHEN 2 THEN 'adores' ELSE 'owns' END || ' | thing'"


@register(
    """WITH o AS (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, CAST(event_id AS VARCHAR)) AS n, CASE event_id % 4 WHEN 0 THEN 'enjoys' WHEN 1 THEN 'likes' WHEN 2 THEN 'adores' ELSE 'owns' END AS p FROM events),
f AS (SELECT (SELECT p FROM o WHERE p IN ('enjoys', 'likes', 'adores') ORDER BY n LIMIT 1) AS fond),
t AS (SELECT event_type, CASE WHEN p = 'owns' THEN 'owns' ELSE fond END AS p FROM o, f)
SELECT DISTINCT 'edge' AS kind, 'rel_' || sha1('entity_' || sha1('generic:' || event_type) || ':' || p || ':entity_' || sha1('generic:thing')) AS name FROM t
UNION ALL SELECT 'predicate', fond FROM f"""
)
def ingest_gated_in_order(g):
    """Three words for one thing: the first is approved, and later ones are led to it."""
    entries = _entries(g.base("events"), F.col("event_id"), F.lit("global"), F.col("ts"), _COINED)
    led = " ".join(f"WHEN array_contains(split(known_names, ', '), '{p}') THEN 'EXISTING: {p}'" for p in ("enjoys", "likes", "adores"))
    gate = F.expr(f"CASE WHEN predicate = 'owns' THEN 'EXISTING: owns' {led} ELSE 'NEW' END")
    done = ingest.ingest(entries, g.node_keys.select("uuid", "content", "node_type"), PREDICATES, answers={"extract": "answer", "gate": gate})
    return done.edges.select(F.lit("edge").alias("kind"), F.col("uuid").alias("name")).unionByName(done.predicates.select(F.lit("predicate").alias("kind"), "name"))


@register(
    """WITH o AS (SELECT l_orderkey AS pos, l_partkey AS id, CASE WHEN l_linenumber = 1 THEN 'created' ELSE 'updated' END AS kind FROM lineitem),
f AS (SELECT id, kind, min(pos) AS pos FROM o GROUP BY 1, 2), c AS (SELECT id, pos AS cp FROM f WHERE kind = 'created')
SELECT f.pos, f.id, f.kind FROM f LEFT JOIN c USING (id) WHERE kind = 'created' OR cp IS NULL OR f.pos < cp"""
)
def merged_outcomes(g):
    o = g.base("lineitem").select(F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") == 1, "created").otherwise("updated").alias("kind"))
    return ingest.merged_outcomes(o)


@register(
    """SELECT DISTINCT 'core_' || sha1('user_' || CAST(user_id AS VARCHAR) || ':Fact of user_' || CAST(user_id AS VARCHAR)) AS entry_id, 'Fact of user_' || CAST(user_id AS VARCHAR) AS text, 'core_memory' AS domain FROM events"""
)
def consolidation(g):
    answer = F.concat(F.lit("- Fact of "), F.col("user_id"), F.lit("\n"))
    return ingest.consolidation_entries(g.logs, F.lit(LOGS_NOW).cast("timestamp"), answer=answer).select("entry_id", "text", "domain")


# Rendering and second passes

_ONE_HOP = expand_sql([NATION_0], hops=1, k=20)


def _one_hop(g):
    return _expand(g, seed(g, "nation_0"), hops=1)


@register(
    f"""WITH x AS (SELECT * FROM ({_ONE_HOP}) y), n AS (SELECT nodes.* FROM nodes JOIN x ON x.kind = 'node' AND x.uuid = nodes.uuid), e AS (SELECT edges.* FROM edges JOIN x ON x.kind = 'edge' AND x.uuid = edges.uuid)
SELECT 0 AS part, '## Knowledge Graph' AS line UNION ALL SELECT 2, '## Relationships'
UNION ALL SELECT 1, '- **' || node_type || '** `' || substr(uuid, 1, 8) || '`' || CASE WHEN uuid = {NATION_0} THEN ' [SEED]' ELSE '' END || ': ' || content || ' (metadata={{}})' FROM n WHERE node_type NOT IN ('log', 'chunk')
UNION ALL SELECT 3, '- ' || {_LABEL.format('s', 'subject_uuid')} || ' --[' || predicate || ']--> ' || {_LABEL.format('o', 'object_uuid')} FROM e LEFT JOIN n s ON s.uuid = e.subject_uuid LEFT JOIN n o ON o.uuid = e.object_uuid""",
    "nodes",
    "edges",
)
def markdown(g):
    return render.markdown(_one_hop(g), seed(g, "nation_0")).select("pos.part", "line")


@register(
    f"""WITH x AS (SELECT * FROM ({_ONE_HOP}) y)
SELECT 0 AS part, 'digraph memory {{' AS line UNION ALL SELECT 3, '}}'
UNION ALL SELECT 1, '  "' || nodes.uuid || '" [label="' || substr(content, 1, 40) || '"];' FROM nodes JOIN x ON x.kind = 'node' AND x.uuid = nodes.uuid WHERE node_type <> 'log'
UNION ALL SELECT 2, '  "' || subject_uuid || '" -> "' || object_uuid || '" [label="' || predicate || '"];' FROM edges JOIN x ON x.kind = 'edge' AND x.uuid = edges.uuid""",
    "nodes",
    "edges",
)
def dot_export(g):
    return render.dot(_one_hop(g)).select("pos.part", "line")


def _hits(limit):
    return [
        "SELECT uuid FROM (" + _search_sql("nodes", "t.vec_id", "t.user_id = 'global' AND t.node_type <> 'log'", _NODE_LIFE, limit, 0, NODES_NOW, "updated_at", "n_obs") + ") a",
        "SELECT uuid FROM (" + _search_sql("edges", f"t.first_j % {SIZE}", "t.user_id = 'global'", "90.0", limit, 0, NODES_NOW, "CAST(NULL AS TIMESTAMP)", "n_obs") + ") b",
    ]


@register(expand_sql(_hits(5), hops=1, k=20, query=V0, selects=True), "nodes", "edges")
def search_then_expand(g):
    return _expanded(traverse.search_then_expand(g.by_key.nodes, g.by_key, _q(g), NODES_NOW, limit=5, hops=1, facts=_vector_edges(g)))


@register(f"SELECT * FROM ({_ONE_HOP}) a UNION SELECT * FROM ({expand_sql(_hits(5)[:1], hops=1, k=20, selects=True)}) b", "nodes", "edges")
def two_pass_retrieval(g):
    """A subgraph with what the hits of a gap query add."""
    base = traverse.expand(g.by_key.nodes, g.by_key, seed(g, "nation_0"), hops=1)
    return _expanded(summarize.fill_gaps(base, g.by_key.nodes, g.by_key, [_q(g)], NODES_NOW))


# Code

_CODE_CHUNKS = """cut AS (SELECT uuid AS document_id, i AS chunk_index, x AS content FROM (SELECT uuid, unnest(l) AS x, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS i FROM (SELECT uuid, CASE k % 4
WHEN 0 THEN ['import os.path' || chr(10) || 'from json import loads' || chr(10) || chr(10) || 'class ' || brand || ':' || chr(10) || '    def size(self):' || chr(10) || '        pass', 'def f' || CAST(size AS VARCHAR) || '():' || chr(10) || '    return 1']
ELSE [trim(content, chr(10))] END AS l FROM code_docs) a) b)"""
_CODE_FACTS = """facts AS (SELECT uuid, k, 'm' || CAST(k AS VARCHAR) AS m, brand, size FROM code_docs),
triples AS (SELECT uuid, k, m AS subject, 'imports' AS predicate, 'os' AS object FROM facts WHERE k % 4 = 0 UNION ALL SELECT uuid, k, m, 'imports', 'json' FROM facts WHERE k % 4 = 0
UNION ALL SELECT uuid, k, m, 'defines', brand FROM facts WHERE k % 4 = 0 UNION ALL SELECT uuid, k, brand, 'has_method', 'size' FROM facts WHERE k % 4 = 0 UNION ALL SELECT uuid, k, m, 'defines', 'f' || CAST(size AS VARCHAR) FROM facts WHERE k % 4 = 0
UNION ALL SELECT uuid, k, m, 'imports', 'x' FROM facts WHERE k % 4 = 1 UNION ALL SELECT uuid, k, m, 'imports', 'lib' FROM facts WHERE k % 4 = 1 UNION ALL SELECT uuid, k, m, 'imports', 'zed' FROM facts WHERE k % 4 = 1
UNION ALL SELECT uuid, k, m, 'imports', brand FROM facts WHERE k % 4 = 2)"""
_OBJECT_TYPE = "CASE predicate WHEN 'imports' THEN 'module' ELSE 'function' END"


@register(f"WITH {_CODE_FACTS} SELECT uuid AS document_id, subject, predicate, object, 'module' AS subject_type, {_OBJECT_TYPE} AS object_type FROM triples", "code_docs")
def code_triples(g):
    return corpus.structural_edges(g.code_docs)


@register(f"WITH {_CODE_CHUNKS} SELECT * FROM cut", "code_docs")
def chunk_code(g):
    return corpus.chunks(g.code_docs.select("uuid", "filename", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def _code_ingest(g):
    """Documents of which some are stored as they are, some otherwise, some not at all."""
    stored = g.code_docs.where("k % 5 <= 1").select("uuid", F.when(F.col("k") % 5 == 0, ids.content_hash(F.col("content"))).otherwise("old").alias("content_hash"))
    nodes = g.node_keys.select("uuid", "content", "node_type", F.lit("global").alias("user_id"), F.lit(0.5).alias("weight"), F.lit(None).cast("string").alias("document_id"))
    old = g.code_docs.select(F.concat(F.lit("old_"), "uuid").alias("uuid"), "content", F.lit("chunk").alias("node_type"), F.lit("global").alias("user_id"), F.when(F.col("k") % 2 == 0, 0.4).otherwise(0.0).alias("weight"), F.col("uuid").alias("document_id"))
    answers = {"summary": F.concat(F.lit("Of "), F.col("filename")), "extract": F.lit("status: ok\ntriples:\nos | is_a | Library | generic | generic")}
    return corpus.ingest_corpus(g.code_docs.select("corpus_id", "filename", "content"), stored, nodes.unionByName(old), at="2024-01-01T00:00:00+00:00", answers=answers)


_DONE = "todo AS (SELECT uuid, k FROM code_docs WHERE k % 5 <> 0)"
_SUMMARY_LOG = "'log_' || sha1('global:summary_' || uuid)"


@register(
    f"""WITH {_CODE_CHUNKS}, {_CODE_FACTS}, {_DONE}, c AS (SELECT cut.*, {_CHUNK_ID} AS uuid FROM cut JOIN todo ON todo.uuid = document_id), e AS (
SELECT 'corpus_' || sha1('corpus:code') AS s, 'contains' AS p, uuid AS o FROM todo WHERE k % 5 <> 1
UNION SELECT uuid, 'has_summary', {_SUMMARY_LOG} FROM todo UNION SELECT document_id, 'has_chunk', uuid FROM c
UNION SELECT a.uuid, 'next_chunk', b.uuid FROM c a JOIN c b ON a.document_id = b.document_id AND b.chunk_index = a.chunk_index + 1
UNION SELECT 'entity_' || sha1('generic:os'), 'mentioned_in', c.uuid FROM c JOIN todo ON todo.uuid = document_id WHERE k % 4 = 3 OR k % 4 = 0 AND chunk_index = 0
UNION SELECT 'entity_' || sha1('generic:os'), 'is_a', 'entity_' || sha1('generic:library') FROM todo
UNION SELECT 'entity_' || sha1('module:' || lower(subject)), predicate, 'entity_' || sha1({_OBJECT_TYPE} || ':' || lower(object)) FROM triples JOIN todo USING (uuid))
SELECT 'rel_' || sha1(s || ':' || p || ':' || o) AS uuid, s AS subject_uuid, p AS predicate, o AS object_uuid FROM e""",
    "code_docs",
)
def corpus_ingest_edges(g):
    return _code_ingest(g).edges.select("uuid", "subject_uuid", "predicate", "object_uuid")


@register(
    f"""WITH {_CODE_CHUNKS}, {_CODE_FACTS}, {_DONE} SELECT 'corpus_' || sha1('corpus:code') AS uuid, 'corpus' AS node_type
UNION SELECT uuid, 'document' FROM todo UNION SELECT {_SUMMARY_LOG}, 'log' FROM todo UNION SELECT {_CHUNK_ID}, 'chunk' FROM cut JOIN todo ON todo.uuid = document_id
UNION SELECT 'entity_' || sha1('generic:' || x), 'generic' FROM (VALUES ('os'), ('library')) v(x)
UNION SELECT 'entity_' || sha1('module:' || lower(subject)), 'module' FROM triples JOIN todo USING (uuid) UNION SELECT 'entity_' || sha1({_OBJECT_TYPE} || ':' || lower(object)), {_OBJECT_TYPE} FROM triples JOIN todo USING (uuid)""",
    "code_docs",
)
def corpus_ingest_nodes(g):
    return _code_ingest(g).nodes.select("uuid", "node_type")


@register(
    f"""WITH {_DONE} SELECT 'mark' AS kind, uuid FROM todo UNION ALL SELECT 'dead', 'old_' || uuid FROM todo WHERE k % 5 = 1 AND k % 2 = 0
UNION ALL SELECT 'id', uuid FROM todo UNION ALL SELECT 'id', 'entity_' || sha1('generic:' || x) FROM (VALUES ('os'), ('library')) v(x)""",
    "code_docs",
)
def corpus_ingest_marks(g):
    done = _code_ingest(g)
    marked = done.marks.where("pipeline_done_at = '2024-01-01T00:00:00+00:00' AND pipeline_error IS NULL")
    return marked.select(F.lit("mark").alias("kind"), "uuid").unionByName(done.dead.select(F.lit("dead").alias("kind"), "uuid")).unionByName(done.acks.select(F.lit("id").alias("kind"), F.col("id").alias("uuid")))


@register(
    """WITH s AS (SELECT DISTINCT user_id, 'core_' || sha1('user_' || CAST(user_id AS VARCHAR) || ':Fact of user_' || CAST(user_id AS VARCHAR)) AS entry_id FROM events)
SELECT 'log_' || sha1('user_' || CAST(user_id AS VARCHAR) || ':' || entry_id) AS uuid, 'log' AS node_type, 'core_memory' AS domain FROM s
UNION ALL SELECT 'entity_' || sha1('self:user_' || CAST(user_id AS VARCHAR)), 'person', NULL FROM s UNION ALL SELECT 'entity_' || sha1('generic:tea'), 'generic', NULL"""
)
def consolidation_ingest(g):
    """The statements go through ingest themselves, in the core domain."""
    answers = {"consolidate": F.concat(F.lit("- Fact of "), F.col("user_id"), F.lit("\n")), "extract": F.lit("status: ok\ntriples:\nSELF | owns | tea")}
    done = ingest.consolidate(g.logs, g.node_keys.select("uuid", "content", "node_type"), PREDICATES, F.lit(LOGS_NOW).cast("timestamp"), answers=answers)
    return done.logs.select("uuid", "node_type", "domain").unionByName(done.nodes.select("uuid", "node_type", F.lit(None).cast("string").alias("domain")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
