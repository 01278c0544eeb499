"""Every query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from docengine.queries import ORACLE_SQL, QUERIES

SRC = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SRC}/{t}.parquet'")
    return con


def canon(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SRC)
    cols = sorted(out.columns)
    got = canon(tuple(r) for r in out.select(*[f"`{c}`" for c in cols]).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    res = duck.sql(ORACLE_SQL[name])
    assert sorted(res.columns) == cols
    order = [res.columns.index(c) for c in cols]
    assert got == canon(tuple(r[i] for i in order) for r in res.fetchall())


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith(("docengine.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "docengine.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_plans_have_what_they_should(spark):
    """Filters and columns reach the scan; no product of tables."""
    plan = lambda name: QUERIES[name](spark, SRC)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan("link_classify") and "BroadcastNestedLoop" not in plan("link_classify")
    assert "text" not in plan("filter_kind_role").split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan("vec_sign_hamming_topk")


def test_every_file_is_listed(spark, duck):
    got = QUERIES["font_catalog"](spark, SRC).collect()
    assert sum(r["n"] for r in got) == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert sorted(x for r in got if r["n"] for x in r["files"].split(",")) == sorted(r[0] for r in duck.sql("SELECT c_name FROM customer").fetchall())


def test_tree_of_all_documents(spark, duck):
    from docengine.operators import graph

    got = QUERIES["framework_tree"](spark, SRC).count()
    assert got == duck.sql("SELECT count(*) FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT o_orderkey FROM orders UNION SELECT p_partkey FROM part) AND l_partkey IN (SELECT o_orderkey FROM orders UNION SELECT p_partkey FROM part)").fetchall()[0][0]
    edges = spark.createDataFrame([(1, 2, "child"), (1, 9, "child"), (9, 2, "child"), (2, 1, "see_also")], "from_key long, to_key long, relation_type string")
    assert [(r["from_key"], r["to_key"]) for r in graph.framework_tree(edges, spark.createDataFrame([(1,), (2,)], "key long")).collect()] == [(1, 2)]


def test_crawl_goes_to_the_end(spark, duck):
    from docengine.operators import graph

    chain = spark.createDataFrame([(f"a/{i}", f"a/{i + 1}") for i in range(57)] + [("a/3", "b/0"), ("a/57", "a/0")], "from_key string, to_key string")
    got = graph.crawl_frontier(chain, spark.createDataFrame([("a/0",)], "key string")).collect()
    assert sorted((r["depth"], r["key"]) for r in got) == [(i, f"a/{i}") for i in range(58)]

    to: dict = {}
    for a, b in duck.sql("SELECT l_orderkey, l_partkey FROM lineitem").fetchall():
        if a % 2 == b % 2:
            to.setdefault(f"{a % 2}/{a}", set()).add(f"{b % 2}/{b}")
    depth, front = {"1/11": 0}, ["1/11"]
    while front:
        key = front.pop(0)
        for k in to.get(key, ()):
            if k not in depth:
                depth[k] = depth[key] + 1
                front.append(k)
    got = QUERIES["crawl_frontier"](spark, SRC).collect()
    assert len(got) == len(depth) > 50 and {r["key"]: r["depth"] for r in got} == depth
