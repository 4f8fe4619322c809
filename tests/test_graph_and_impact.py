"""Graph questions, merging, impact, reports, snapshots, service and stream on small fixtures."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from headwater.operators import graph, impact, merge, report, store
from headwater.operators.dbt_extract import parse_dbt_models
from headwater.operators.script_extract import SCHEMA as SCRIPT_SCHEMA
from headwater.operators.service import Service, UnknownTable
from headwater.operators.sql_extract import RECORD_SCHEMA
from headwater.sources.files import airflow_tasks
from headwater.streaming.ingest import ingest_stream

from .test_sql import RETAIL


def records(spark, rows):
    full = [(i, 0, t, s, m, k, "", "p", []) for i, (t, s, m, k) in enumerate(rows)]
    return spark.createDataFrame(full, RECORD_SCHEMA)


def table_graph(spark, edges):
    return graph.graph_of(records(spark, [(b, [a], [("x", "x")], "filter") for a, b in edges]), "-")


CHAIN = [("source.raw", "staging.orders"), ("staging.orders", "warehouse.daily"), ("warehouse.daily", "mart.sales")]


def test_closures(spark):
    n, e = table_graph(spark, CHAIN)
    up = {r.node: r.direct for r in graph.upstream(n, e, "mart.sales").collect()}
    assert up == {"source.raw": False, "staging.orders": False, "warehouse.daily": True}
    assert graph.downstream(n, e, "source.raw").count() == 3 and graph.upstream(n, e, "nowhere").count() == 0
    assert {r.node: r.is_source for r in n.collect()} == {"source.raw": True, "staging.orders": False, "warehouse.daily": False, "mart.sales": False}
    assert [(r.node, r.level) for r in graph.topological_order(n, e).collect()] == [("source.raw", 0), ("staging.orders", 1), ("warehouse.daily", 2), ("mart.sales", 3)]


def test_diamond_and_cycle(spark):
    n, e = table_graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert [(r.node, r.hop, r.path) for r in graph.impact_analysis(e, "a").collect()] == [("b", 1, ["a", "b"]), ("c", 1, ["a", "c"]), ("d", 2, ["a", "b", "d"])]
    assert sorted(r.path for r in graph.end_to_end_paths(e, "a", "d").collect()) == [["a", "b", "d"], ["a", "c", "d"]]
    assert graph.end_to_end_paths(e, "a", "a").count() == 0 and graph.end_to_end_paths(e, "d", "a").count() == 0
    n, e = table_graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert graph.downstream(n, e, "a").count() == 2 and {r.level for r in graph.topological_order(n, e).collect()} == {None}
    assert {(r.node, r.upstream_count, r.downstream_count) for r in graph.closure_counts(n, e).collect()} == {("a", 2, 2), ("b", 2, 2), ("c", 2, 2)}


def test_upserts(spark):
    n, e = graph.graph_of(records(spark, [("t", ["a"], [("x", "1")], "filter"), ("t", ["a", "b"], [("x", "2"), ("y", "3")], "join"), ("z", [], [], "passthrough")]), "-")
    assert {(r.src, r.dst, r.transformation_type, len(r.column_mappings)) for r in e.collect()} == {("a", "t", "join", 2), ("b", "t", "join", 2)}
    assert [tuple(m) for m in graph.edge_lineage(e, "a", "t").collect()] == [("x", "2"), ("y", "3")] and graph.edge_lineage(e, "t", "a").count() == 0
    assert {r.node: r.is_source for r in n.collect()} == {"t": False, "a": True, "b": True, "z": True}
    more = graph.add_node(n, "new", schema="s")
    assert graph.node_metadata(more, "new").first().schema == "s" and graph.add_node(more, "a", schema="q").where("schema = 'q'").count() == 0


def unified(spark):
    u = merge.Unified.empty(spark)
    u = merge.add_sql(u, *graph.graph_of(records(spark, [("staging.orders", ["source.raw_orders"], [("order_id", "order_id"), ("amount", "price*qty")], "filter"), ("mart.revenue", ["staging.orders"], [("total", "SUM(amount)")], "aggregate")]), "-"))
    s3 = lambda p, k: (f"s3://lake/{p}/", "parquet", k)
    scripts = spark.createDataFrame([("etl", [s3("raw/orders", "source"), s3("raw/events", "source")], [s3("processed/orders", "sink")], [], [], "", None)], SCRIPT_SCHEMA)
    u = merge.add_spark(u, scripts.selectExpr("*", "0 AS ord"))
    models = parse_dbt_models(spark.createDataFrame([("orders_fact", "SELECT * FROM {{ ref('stg_orders') }}"), ("stg_orders", "SELECT * FROM {{ source('raw', 'orders') }}")], "model_name string, sql string"))
    u = merge.add_dbt(u, models.selectExpr("*", "0 AS ord"))
    tasks = airflow_tasks([
        {"dag_id": "ingest_dag", "task_id": "load_orders", "input_paths": ["s3://source/orders.csv"], "output_paths": ["s3://lake/raw/orders/"]},
        {"dag_id": "ingest_dag", "task_id": "run_spark", "operator": "SparkSubmitOperator", "input_paths": ["S3://lake/raw/orders"], "output_paths": ["s3://lake/processed/orders/"], "upstream_task_ids": ["load_orders", "gone"]},
    ], spark)
    return merge.add_airflow(u, tasks.selectExpr("*", "0 AS ord"))


def test_merge(spark):
    u = merge.with_cross_edges(unified(spark))
    assert u.nodes.count() == 11 and u.edges.count() == 10
    cross = {(r.src, r.dst, r.shared_path) for r in u.edges.where("system = 'cross'").collect()}
    task, lake = "airflow::ingest_dag.", "spark::s3://lake/"
    assert cross == {(task + "load_orders", lake + "raw/orders/", "s3://lake/raw/orders"), (task + "run_spark", lake + "raw/orders/", "s3://lake/raw/orders"), (task + "run_spark", lake + "processed/orders/", "s3://lake/processed/orders")}
    assert merge.cross_edges(u).count() == 0
    assert {r.system: r.n for r in merge.coverage(u.nodes).collect()} == {"sql": 3, "spark": 3, "dbt": 3, "airflow": 2}
    assert tuple(merge.counts(u.nodes, u.edges).first()) == (2, 3)
    n, e = merge.subgraph(u, "dbt")
    assert (n.count(), e.count()) == (3, 2)
    assert merge.end_to_end_paths(u, task + "load_orders", lake + "processed/orders/").count() == 3
    assert {r.system: (r.nodes, r.edges) for r in merge.comparison(u.nodes, u.edges).collect()} == {"airflow": (2, 1), "sql": (3, 2), "spark": (3, 2), "dbt": (3, 2)}
    page = report.unified_html(u.nodes, u.edges)
    assert "lineage-data" in page and "DbtModel" in page and "<b>3</b> cross" in page


def test_interactive_page(spark):
    u = merge.with_cross_edges(unified(spark))
    page = report.unified_html(u.nodes, u.edges)
    assert page.count("<g class='node'") == 11 and page.count("<path d='M") == 10 + 1 and page.count("stroke-dasharray") == 3 and "id='sidebar'" in page
    assert "System: dbt\nType: DbtModel" in page
    n = u.nodes.withColumn("label", F.concat(F.lit("<i>'\"&"), "label", F.lit("x" * 40))).withColumn("node_type", F.when(F.col("system") == "sql", "intermediate").otherwise(F.col("node_type")))
    odd = report.unified_html(n, u.edges, system=["sql", "dbt"], hide_intermediate=True)
    assert odd.count("<g class='node'") == 3 and "<i>" not in odd and "..." in odd
    with pytest.raises(ValueError, match="more than 5 rows"):
        report.unified_html(u.nodes, u.edges, most=5)
    with pytest.raises(ValueError, match="more than 1 rows"):
        report.console_report(u.nodes, u.edges, spark.createDataFrame([], "hop int, node string, path array<string>"), most=1)
    cycle = report._columns_of(["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "b"), ("a", "a"), ("d", "x")])
    assert cycle == {"a": 0, "b": 1, "c": 0, "d": 0}


def impact_graph(spark, nodes, edges):
    n = spark.createDataFrame([(x, x, s, "T", {}, [i]) for i, (x, s) in enumerate(nodes)], merge.NODE_SCHEMA)
    e = spark.createDataFrame([(a, b, "x", "", [(t, s) for t, s in m], None, None, [i]) for i, (a, b, m) in enumerate(edges)], merge.EDGE_SCHEMA)
    return n, e


LINEAR = ([("a", "sql"), ("b", "sql"), ("c", "sql"), ("d", "sql")], [("a", "b", [("amount", "amount")]), ("b", "c", [("total", "SUM(amount)")]), ("c", "d", [("revenue", "total")])])
SYSTEMS = ([("a", "sql"), ("b", "spark"), ("c", "dbt"), ("d", "airflow")], [("a", "b", [("amount", "amount")]), ("b", "c", []), ("c", "d", [])])
WILD = ([("a", "sql"), ("b", "sql")], [("a", "b", [("*", "*")])])
DIAMOND = ([(x, "sql") for x in "abcd"], [("a", "b", [("p", "x")]), ("a", "c", [("p", "y")]), ("b", "d", [("p", "z")]), ("c", "d", [("p", "x")])])
CYCLE = ([(x, "sql") for x in "abc"], [("a", "b", []), ("b", "c", []), ("c", "a", [])])


@pytest.mark.parametrize(
    ("shape", "column", "kind", "want", "hours"),
    [
        (LINEAR, None, "rename", "b1B c2B d3B", "2.70"), (LINEAR, "amount", "rename", "b1B c2B d3O", "1.90"), (LINEAR, "amount", "drop", "b1B c2B d3O", "1.90"), (LINEAR, "amount", "type_change", "b1W c2W d3O", "0.76"),
        (LINEAR, "new_col", "add", "b1W c2W d3O", "0.76"), (LINEAR, "total", "rename", "b1W c2W d3B", "1.56"), (SYSTEMS, None, "drop", "b1B c2B d3B", "4.15"), (SYSTEMS, "amount", "rename", "b1B c2W d3O", "2.68"),
        (WILD, "any", "rename", "b1W", "0.40"), (DIAMOND, "x", "rename", "b1B c1W d2W", "1.76"), (CYCLE, None, "drop", "b1B c2B", "1.90"),
    ],
)
def test_blast_radius(spark, shape, column, kind, want, hours):
    n, e = impact_graph(spark, *shape)
    c = impact.changes(spark, [("a", column, kind), ("unknown", column, kind)])
    found = impact.simulate(n, e, c)
    assert " ".join(f"{r.node}{r.hop_distance}{r.severity[0]}" for r in impact.in_order(found).collect()) == want
    totals = {r.change_id: r for r in impact.totals(c, found).collect()}
    assert totals["0"].total_fix_hours == Decimal(hours) and totals["1"].total_impacted == 0
    assert totals["0"].total_impacted == totals["0"].breaking_count + totals["0"].warning_count + totals["0"].ok_count


def test_reasons_and_forms(spark):
    n, e = impact_graph(spark, *LINEAR)
    c = impact.changes(spark, [("a", "amount", "drop"), ("a", None, "rename")])
    found = impact.simulate(n, e, c)
    rows = {(r.change_id, r.node): r for r in found.collect()}
    assert rows["0", "b"].reason == "Column 'amount' is dropped; consumed in 'amount'" and rows["0", "d"].reason == "No direct dependency on 'amount' detected at hop 3"
    assert rows["1", "d"].reason == "Whole-table change (rename) propagates downstream" and rows["1", "d"].path_from_source == ["a", "b", "c", "d"]
    text = {r.change_id: r.summary for r in impact.summary(c, found).collect()}
    assert "Changed column: N/A" in text["1"] and text["0"].endswith("By system:\n  sql           BREAKING=2  WARNING=0") and "Estimated fix : 1.9 hrs" in text["0"]
    assert '"total_impacted":3' in impact.as_json(c, found).where("change_id = '0'").first().json
    assert impact.simulate(n, e, c.limit(0)).count() == 0
    assert [(r.node, r.score) for r in impact.top_risk(n, e, 2).collect()] == [("a", 0.3333), ("b", 0.3333)]
    assert impact.top_risk(n.limit(0), e.limit(0)).count() == 0
    assert report.impact_grid(found).columns == ["node", "system", "severity", "hop", "reason", "hours"]


def test_reports(spark):
    n, e = table_graph(spark, [("source.raw-orders", "staging.orders"), ("staging.orders", "mart.<sales>")])
    text = report.mermaid(n, e)
    lines = text.split("\n")
    assert lines[0] == "flowchart LR" and text.count('source_raw_orders["source.raw-orders"]') == 1 and '    staging_orders("staging.orders")' in lines
    assert "    source_raw_orders -->|filter| staging_orders" in lines and lines[-1].startswith("    class ")
    page = report.html_report(n, e)
    assert "mart.&lt;sales&gt;" in page and "<b>3</b> tables" in page and "<script" not in page
    assert report.default_target(n).first().node == "source.raw-orders"
    assert report.mapping_preview.__doc__ and "hop 2: mart.<sales>" in report.console_report(n, e, graph.impact_analysis(e, "source.raw-orders"))


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    assert not s.health()
    s.create()
    s.create()
    assert s.health() and s.load_nodes().count() == 0
    n, e = table_graph(spark, CHAIN)
    s.persist(n, e)
    assert s.load_nodes().count() == 4 and s.load_edges().count() == 3
    s.upsert_edges(e.where("src = 'source.raw'").selectExpr("src", "dst", "column_mappings", "'join' AS transformation_type", "pipeline_name", "seq"))
    s.upsert_nodes(n.where("node = 'source.raw'").selectExpr("node", "'x' AS schema", "row_count_estimate", "last_updated", "is_source", "seq"))
    assert s.load_edges().where("transformation_type = 'join'").count() == 1 and s.load_edges().count() == 3
    assert s.load_nodes().where("schema = 'x'").count() == 1 and s.load_nodes().count() == 4


def test_service_and_retail_impact(spark):
    s = Service(spark)
    assert s.parse(";\n".join(RETAIL), "retail") == {"parsed_statements": 5, "tables_added": 8, "edges_added": 7}
    assert s.health() == {"status": "ok", "node_count": 8, "edge_count": 7}
    assert [(r.hop, r.node) for r in s.impact("orders").collect()] == [(1, "raw_orders"), (2, "enriched_orders"), (3, "daily_sales_summary"), (4, "sales_performance")]
    assert s.upstream("sales_performance").count() == 7 and s.lineage("orders")["upstream"].count() == 0
    assert s.parse("INSERT INTO x SELECT a FROM orders") == {"parsed_statements": 1, "tables_added": 1, "edges_added": 1}
    with pytest.raises(UnknownTable):
        s.impact("nowhere")
    assert s.tables().count() == 9 and s.graph().count() == 17 and s.mermaid("TD").startswith("flowchart TD")


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, "p", sql) for i, sql in enumerate(RETAIL)]
    spark.createDataFrame(rows[:3], "text_id long, pipeline_name string, sql string").coalesce(1).write.json(str(source))
    s = store.Store(spark, str(tmp_path / "db"))

    def go():
        texts = spark.readStream.schema("text_id long, pipeline_name string, sql string").json(str(source))
        ingest_stream(texts, s, str(tmp_path / "ck")).awaitTermination()

    go()
    spark.createDataFrame(rows[3:], "text_id long, pipeline_name string, sql string").coalesce(1).write.mode("append").json(str(source))
    go()
    assert s.load_nodes().count() == 8 and s.load_edges().count() == 7
    assert {r.node for r in s.load_nodes().where("is_source").collect()} == {"orders", "customers", "products"}
