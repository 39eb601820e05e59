"""Expansions of one request compute the rows of their keys and write no graph."""

import pytest

from memweave.operators import traverse
from memweave.plans import registry
from memweave.plans.fixtures import Graph

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["expand_source_filter", "expand_self_floor", "dot_export"])
def test_no_graph_is_written(spark, monkeypatch, name):
    def refuse(*args, **kwargs):
        raise AssertionError("the whole graph is written")

    monkeypatch.setattr(traverse.GraphStore, "__init__", refuse)
    monkeypatch.setattr(traverse.GraphStore, "write", refuse)
    assert registry.queries()[name](spark, SF).count() > 0


def test_rows_by_key_are_those_of_the_table(spark):
    g = Graph(spark, SF)
    keys = [r["uuid"] for r in g.node_keys.where("k < 3").select("uuid").collect()]
    for column in ("subject_uuid", "object_uuid"):
        whole = g.edges.where(g.edges[column].isin(keys)).collect()
        assert whole and sorted(g.by_key.edges.pick(column, keys).collect()) == sorted(whole)
    some = g.by_key.nodes.table.where(g.by_key.nodes.table["uuid"].isin(keys)).drop("embedding")
    key = lambda r: (r["uuid"], str(r))
    assert sorted(g.by_key.nodes.pick("uuid", keys).drop("embedding").collect(), key=key) == sorted(some.collect(), key=key)


def test_facts_are_grouped_by_names_and_pairs_carry_no_vectors(spark):
    """Rows by names are the view's; a request's pairs with nodes name their vectors and find what they find with them."""
    from memweave.operators import bulk

    g = Graph(spark, SF)
    view = g.view("edges")
    assert sorted(g.edges.collect()) == sorted(view.select(g.edges.columns).collect())
    assert g.edges._jdf.queryExecution().optimizedPlan().toString().count("sha1") < view._jdf.queryExecution().optimizedPlan().toString().count("sha1")
    assert "vec_id" in g.store.nodes.columns and "embedding" not in g.store.nodes.columns
    asked = g.vector_named(g.base("supplier"), "s_suppkey").selectExpr("s_suppkey AS request_id", "'global' AS user_id", "CAST(NULL AS STRING) AS source", "vec_id")
    seeds = g.base("supplier").selectExpr("s_suppkey AS request_id", "'entity_' || sha1('organization:' || lower(trim(s_name))) AS uuid")
    named = bulk.expand_requests(asked, seeds, g.store.nodes, g.store, limit_per_hop=3, vectors=g.vectors)
    held = bulk.expand_requests(asked.join(g.vectors, "vec_id"), seeds, g.store.nodes.join(g.vectors, "vec_id"), g.store, limit_per_hop=3)
    for kind in ("nodes", "edges"):
        rows = sorted(getattr(named, kind).collect())
        assert rows and rows == sorted(getattr(held, kind).collect())
