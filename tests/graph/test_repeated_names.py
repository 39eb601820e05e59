"""Queries over tables that are repeated under other keys and the same names, against their SQL: ids then stand for several rows."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from memweave.plans import registry

SF, TIMES = "/root/testdata/sf0.001", 3
#: Keys, and by how much each copy shifts them.
KEYS = {
    "customer": {"c_custkey": 151}, "supplier": {"s_suppkey": 10}, "part": {"p_partkey": 200}, "orders": {"o_orderkey": 1500, "o_custkey": 151},
    "lineitem": {"l_orderkey": 1500, "l_partkey": 200, "l_suppkey": 10}, "events": {"event_id": 1000, "user_id": 151},
}


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder, duck = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(f)[:-8]
        keys = ", ".join(f"{k} + i * {by} AS {k}" for k, by in KEYS.get(name, {}).items())
        rows = f"SELECT * REPLACE ({keys}) FROM read_parquet('{f}'), (SELECT unnest(range({TIMES})) AS i)" if keys else f"SELECT * FROM read_parquet('{f}')"
        rows = f"SELECT * EXCLUDE (i) FROM ({rows})" if keys else rows
        duck.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return str(folder), duck


@pytest.mark.parametrize("name", ["search_requests", "search_edge_requests", "entity_cascade", "entity_nearest_match"])
def test_agrees(spark, repeated, name):
    folder, duck = repeated
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    result = duck.execute(registry.oracle_sql()[name])
    at = [x[0] for x in result.description]
    want = Counter(tuple(r[at.index(c)] for c in columns) for r in result.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name, label", [("search_requests", "bulk-members"), ("search_edge_requests", "bulk-members"), ("entity_cascade", "node-vectors"), ("entity_nearest_match", "node-vectors")])
def test_rows_are_taken_without_vectors(spark, monkeypatch, name, label):
    """What is written for each row names its vector, which is not read for it; classes of rows are made before their vectors join."""
    from memweave.operators import bulk, resolve

    seen = {}
    for module in (bulk, resolve):
        real = module.materialize

        def spy(df, label, real=real):
            seen[label] = df.columns, df._jdf.queryExecution().executedPlan().toString()
            return real(df, label)

        monkeypatch.setattr(module, "materialize", spy)
    registry.queries()[name](spark, SF)
    columns, plan = seen[label]
    if label == "bulk-members":
        assert "vec_id" in columns and not {"v", "embedding"} & set(columns) and "embedding#" not in plan
    else:
        assert [line for line in plan.split("\n") if "partial_min(uuid" in line] and not [line for line in plan.split("\n") if "Aggregate" in line and "first(" in line]
        assert "lineitem" not in plan
