"""Registered queries over the whole provenance graph, against brute force on small tables."""

from collections import Counter, defaultdict

import pytest

from headwater.queries import Q

ROWS = {
    "region": ("r_regionkey long", [(0,), (1,)]),
    "nation": ("n_nationkey long, n_regionkey long", [(3, 0), (4, 1), (5, 1)]),
    "customer": ("c_custkey long, c_nationkey long", [(1, 3), (2, 4), (3, 4)]),
    "supplier": ("s_suppkey long, s_nationkey long", [(1, 3), (2, 5)]),
    "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 1), (3, 2)]),
    "part": ("p_partkey long", [(1,), (2,), (3,), (4,)]),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(1, 1, 1), (1, 2, 2), (2, 1, 2), (3, 3, 1), (3, 3, 1)]),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def foreign_keys():
    """Nodes and (src, dst, system, level) of the foreign-key graph."""
    r = {name: rows for name, (_, rows) in ROWS.items()}
    nodes = {f"{t}::{row[0]}" for t in r if t != "lineitem" for row in r[t]}
    edges = {(f"region::{b}", f"nation::{a}", "airflow", 1) for a, b in r["nation"]} | {(f"nation::{b}", f"customer::{a}", "sql", 2) for a, b in r["customer"]}
    edges |= {(f"nation::{b}", f"supplier::{a}", "sql", 3) for a, b in r["supplier"]} | {(f"customer::{b}", f"orders::{a}", "spark", 4) for a, b in r["orders"]}
    edges |= {(f"supplier::{s}", f"part::{p}", "cross", 5) for _, p, s in r["lineitem"]} | {(f"orders::{o}", f"part::{p}", "dbt", 6) for o, p, _ in r["lineitem"]}
    return nodes, edges


def test_closure_counts_of_all_nodes(spark, tables):
    nodes, edges = foreign_keys()
    onward = defaultdict(set)
    for a, b, *_ in edges:
        onward[a].add(b)

    def below(node):
        return set().union(*({x} | below(x) for x in onward[node])) if onward[node] else set()

    down = {n: below(n) for n in nodes}
    up = Counter(x for found in down.values() for x in found)
    got = {r.node: (r.upstream_count, r.downstream_count) for r in Q["closure_counts"](spark, tables).collect()}
    assert got == {n: (up[n], len(down[n])) for n in nodes}


def test_upserts_into_all_nodes_and_edges(spark, tables):
    nodes, edges = foreign_keys()
    got = sorted((r.node, r.version) for r in Q["upsert_nodes"](spark, tables).collect())
    assert got == sorted((n, "new" if n.startswith("nation::") else "old") for n in nodes)
    got = sorted((r.src, r.dst, r.version) for r in Q["upsert_edges"](spark, tables).collect())
    assert got == sorted((a, b, "new" if level == 2 else system) for a, b, system, level in edges)
