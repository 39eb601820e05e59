"""The property-graph model: fixed schemas, and defaults imposed on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifiers, vocabularies and weights that results depend on.
DEFAULT_USER, DEFAULT_TYPE, DEFAULT_DOMAIN = "global", "generic", "general"
CORE_DOMAIN = "core_memory"
LOG, CHUNK, DOCUMENT, CORPUS = "log", "chunk", "document", "corpus"
NODE_TYPES = ["person", "place", "event", "project", "goal", "preference", "asset", "tool", "generic", "log"]
PREDICATES = ["works_at", "lives_in", "knows", "is_part_of", "owns", "uses", "participates_in", "located_at", "created_by", "manages", "reports_to", "related_to", "is_a"]
WEIGHTS = {"entity": 0.55, "edge": 0.8, "log": 0.3, "document": 1.0, "chunk": 0.4, "corpus": 1.0}
HALF_LIFE_DAYS = {"log": 30.0, "entity": 365.0, "edge": 90.0}

_TEXT, _IDS = T.StringType(), T.ArrayType(T.StringType())
_VECTOR = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = _struct(
    uuid=_TEXT, node_type=_TEXT, content=_TEXT, domain=_TEXT, weight=T.DoubleType(), metadata=_TEXT, journal_entry_ids=_IDS, name_key=_TEXT,
    user_id=_TEXT, source=_TEXT, created_at=T.TimestampType(), updated_at=T.TimestampType(), embedding=_VECTOR,
)
EDGES = _struct(
    uuid=_TEXT, subject_uuid=_TEXT, predicate=_TEXT, object_uuid=_TEXT, content=_TEXT, weight=T.DoubleType(), domain=_TEXT, user_id=_TEXT,
    source=_TEXT, journal_entry_ids=_IDS, created_at=T.TimestampType(), updated_at=T.TimestampType(), embedding=_VECTOR,
)


def _fill(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    def column(f: T.StructField):
        if f.name not in df.columns:
            have = F.lit(None)
        elif isinstance(f.dataType, T.TimestampType) and dict(df.dtypes)[f.name] == "string":
            have = F.expr(f"try_to_timestamp(`{f.name}`)")
        else:
            have = F.col(f"`{f.name}`")
        have = have.cast(f.dataType)
        if f.name == "weight" and "significance_weight" in df.columns:
            have = F.coalesce(have, F.col("significance_weight").cast("double"))
        if f.name in defaults:
            default = defaults[f.name]
            have = F.coalesce(have, F.array().cast(_IDS) if default == [] else F.lit(default))
        return have.alias(f.name)

    return df.select(*[column(f) for f in schema])


def as_nodes(df: DataFrame) -> DataFrame:
    """Documents of any shape as nodes. Transient columns such as a search distance fall away."""
    return _fill(df, NODES, {"node_type": DEFAULT_TYPE, "content": "", "domain": DEFAULT_DOMAIN, "weight": 0.5, "metadata": "{}", "journal_entry_ids": [], "user_id": DEFAULT_USER})


def as_edges(df: DataFrame) -> DataFrame:
    """Documents of any shape as edges; rows that lack an end or a predicate stay (``broken_edges`` has them)."""
    texts = {k: "" for k in ("subject_uuid", "predicate", "object_uuid", "content")}
    return _fill(df, EDGES, texts | {"weight": WEIGHTS["edge"], "domain": DEFAULT_DOMAIN, "journal_entry_ids": [], "user_id": DEFAULT_USER})


def broken_edges(edges: DataFrame) -> DataFrame:
    return edges.where("subject_uuid = '' OR predicate = '' OR object_uuid = ''")


def public(df: DataFrame) -> DataFrame:
    """What callers see: no vectors and no transient distance."""
    return df.drop("embedding", "vector_distance")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON string a row; null fields are left out."""
    return public(df).select(F.to_json(F.struct("*")).alias("json"))
