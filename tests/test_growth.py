"""Work that must grow with the input only: what is shuffled, and what one row holds."""

import json

from headwater.operators import graph, impact, merge, sql_extract
from headwater.operators.dbt_extract import parse_dbt_models
from headwater.plans import stages
from headwater.plans.closure import topological_levels
from headwater.plans.stages import spread


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def long_chain(spark, others=20_000, length=8):
    """Nodes, edges: a chain beside many edges that nothing reaches."""
    edges = [(f"c{i}", f"c{i + 1}") for i in range(length)] + [(f"x{i}", f"y{i}") for i in range(others)]
    nodes = sorted({x for e in edges for x in e})
    n = spark.createDataFrame([(x, x, "sql", "T", {}, [i]) for i, x in enumerate(nodes)], merge.NODE_SCHEMA)
    return n, spark.createDataFrame([(a, b, "x", "", [], None, None, [i]) for i, (a, b) in enumerate(edges)], merge.EDGE_SCHEMA), len(edges)


def test_a_blast_in_lines_of_json(spark):
    size = 2 * impact.PIECE + 500
    n = spark.createDataFrame([(x, x, "sql", "T", {}, [i]) for i, x in enumerate(["a", *(f"b{i:05}" for i in range(size))])], merge.NODE_SCHEMA)
    e = spark.createDataFrame([("a", f"b{i:05}", "x", "", [("*", "*")] if i % 2 else [("p", "p")], None, None, [i]) for i in range(size)], merge.EDGE_SCHEMA)
    c = impact.changes(spark, [("a", "p", "drop"), ("b00000", "p", "drop")])
    found = impact.simulate(n, e, c)
    rows = [json.loads(r.json) for r in impact.as_json(c, found).where("change_id = '0'").orderBy("part").collect()]
    assert rows[0]["total_impacted"] == size and max(len(r.get("impacted_nodes", [])) for r in rows) <= impact.PIECE
    listed = [x for r in rows for x in r.get("impacted_nodes", [])]
    assert [x["node"] for x in listed] == [f"b{i:05}" for i in [*range(0, size, 2), *range(1, size, 2)]] and listed[0]["path_from_source"] == ["a", "b00000"]
    assert [json.loads(r.json)["total_impacted"] for r in impact.as_json(c, found).where("change_id = '1'").collect()] == [0]


def test_a_blast_shuffles_the_edges_once(spark):
    n, e, edges = long_chain(spark)
    before = shuffled(spark)
    assert impact.simulate(n, e, impact.changes(spark, [("c0", None, "drop")])).count() == 8
    assert shuffled(spark) - before < 4 * edges


def test_a_graph_reads_its_records_once(spark):
    records = sql_extract.parse_sql(spark, "INSERT INTO a SELECT x FROM b, c; INSERT INTO b SELECT 1 AS x; INSERT INTO a SELECT y FROM d")
    n, e = graph.graph_of(records, "-")
    assert {r.node: r.is_source for r in n.collect()} == {"a": False, "b": True, "c": True, "d": True} and e.count() == 3
    assert n._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


ODD_TEXTS = [
    "INSERT INTO t1 SELECT a1.x2, (p3/*9*/4) AS m5, '6%s%%' AS n FROM s7 a1, S7, s77 WHERE k = 1.5",
    "INSERT INTO t1 SELECT a2.x2, (p3/*9*/4) AS m5, '6%s%%' AS n FROM s7 a1, S1, s07 WHERE k = 1.5",
    "WITH c1 AS (SELECT 1 AS a FROM r01), c2 (z) AS (SELECT * FROM c1) INSERT INTO o1 SELECT c1.a, c3.b FROM c1 JOIN c3 ON c1.a=c3.b; SELECT 10; CREATE TABLE q10 AS SELECT * FROM o1",
    "WITH c1 AS (SELECT 1 AS a FROM r01), c2 (z) AS (SELECT * FROM c2) INSERT INTO o1 SELECT c1.a, c3.b FROM c1 JOIN c1 ON c1.a=c1.b; SELECT 11; CREATE TABLE q11 AS SELECT * FROM o2",
    'INSERT INTO "t1" . "2" SELECT "1".* FROM "x1"."1" "1", `b1`, "1`2", "12"', "INSERT INTO `t1`.`2` SELECT SUM(a1) FROM b1 -- c1\n, t12 /* 3 */", "", "-- 12", "INSERT INTO t1 SELECT ٣1, a FROM b٣1",
    "INSERT INTO t SELECT " + ", ".join(f"a{i}" for i in range(900)) + " FROM s1",
]


def test_texts_of_one_shape_are_read_once(monkeypatch):
    for qualified in (False, True):
        read = sql_extract.reader(True, qualified)
        for _ in range(2):
            assert [read(t) for t in ODD_TEXTS] == [sql_extract._read(t, True, qualified) for t in ODD_TEXTS]
    calls, parse = [], sql_extract.parse_statement
    monkeypatch.setattr(sql_extract, "parse_statement", lambda *a: calls.append(a) or parse(*a))
    read = sql_extract.reader()
    got = [read(f"INSERT INTO t{i} SELECT a{i % 7} AS x FROM s{i // 2}, t{i}") for i in range(100, 1100)]
    assert len(calls) == 1 and [r[0]["source_tables"] for r in got] == [[f"s{i // 2}"] for i in range(100, 1100)]
    monkeypatch.setattr(sql_extract, "SHAPES", 3)
    read = sql_extract.reader()
    assert [read(f"INSERT INTO t{'x' * (i % 9)}{i} SELECT a FROM s")[0]["target_table"] for i in range(50)] == [f"t{'x' * (i % 9)}{i}" for i in range(50)]


def test_tasks_hold_so_many_texts(spark):
    t = spark.range(0, 10_000, 1, 2)
    assert spread(t, 500).rdd.getNumPartitions() == 20 and spread(t, 500).distinct().count() == 10_000
    assert spread(spark.range(0, 10_000, 1, 30), 500).rdd.getNumPartitions() == 30 and spread(t).rdd.getNumPartitions() == 4 and spread(t.limit(0), 500).count() == 0


def test_systems_are_merged_at_once(spark):
    r = graph.graph_of(sql_extract.parse_sql(spark, "; ".join(f"INSERT INTO t{i % 900} SELECT a{i} AS x FROM s{i % 300}" for i in range(1800))).checkpoint(), "-")
    r = [x.checkpoint() for x in r]
    rows = [(f"m{i}", f"SELECT a FROM {{{{ ref('m{i - 1}') }}}}", i) for i in range(50)]
    m = parse_dbt_models(spark.createDataFrame(rows, "model_name string, sql string, ord long")).checkpoint()
    none = merge.Unified.empty(spark)
    apart = merge.add_dbt(merge.add_sql(none, *r, register=True), m)
    once = merge.together(merge.add_sql(none, *r, register=True), merge.add_dbt(none, m))
    for a, b in ((once.nodes, apart.nodes), (once.edges, apart.edges), (once.paths, apart.paths)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    u = merge.Unified(*(x.checkpoint() for x in (once.nodes, once.edges, once.paths)))
    crossed = merge.with_cross_edges(u).edges
    assert "Aggregate" not in crossed.where("system = 'sql'")._jdf.queryExecution().optimizedPlan().toString()


def test_traversals_shuffle_the_edges_once(spark):
    n, e, edges = long_chain(spark)
    last = [f"c{i}" for i in range(9)]
    before = shuffled(spark)
    assert graph.impact_analysis(e, "c0").collect()[-1].path == last and shuffled(spark) - before < 3 * edges
    before = shuffled(spark)
    assert [r.path for r in graph.end_to_end_paths(e.unionByName(e), "c0", "c8").collect()] == [last] and shuffled(spark) - before < 4 * edges
    before = shuffled(spark)
    levels = {r.node: r.level for r in topological_levels(n, e).collect()}
    assert [levels[x] for x in last] == [*range(9)] and len(levels) == n.count() and shuffled(spark) - before < 6 * edges


def test_levels_with_repeated_edges_loops_and_unknown_nodes(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("s", "s"), ("c", "d"), ("s", "t"), ("zz", "u"), ("a", "gone"), ("gone", "c")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcdstu"], "node string")
    assert {r.node: r.level for r in topological_levels(n, e).collect()} == {"a": 0, "b": 1, "c": None, "d": None, "s": None, "t": None, "u": None}
    known = spark.createDataFrame([(x,) for x in "abc"], "node string")
    got = {r.node: (r.upstream_count, r.downstream_count) for r in graph.closure_counts(known, e.where("src <> 's'")).collect()}
    assert got == {"a": (0, 4), "b": (1, 2), "c": (2, 1)}


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(stages, "ROWS", 1000)
    e = spark.range(30_000).selectExpr("'a' || id AS src", "'b' || id AS dst")
    assert stages.parts(e, e.limit(5)) == 30
    a, b = stages.keyed(e, "src", 30), stages.keyed(e.selectExpr("src AS node"), "node", 30)
    assert a.rdd.getNumPartitions() == 30 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    before = shuffled(spark)
    assert stages.kept(a.join(b, a.src == b.node)).count() == 30_000 and shuffled(spark) - before < 100
