"""SQL extraction: one behaviour a test."""

import time

import pytest

from headwater.functions.lexing import split_statements
from headwater.operators.sql_extract import extract_sql, parse_sql, parse_statement

RETAIL = [
    """INSERT INTO staging.raw_orders (order_id) SELECT o.order_id, o.status AS order_status, o.region, NOW() AS extracted_at
       FROM source.orders o WHERE o.d >= CURRENT_DATE - INTERVAL '90 days' AND o.status NOT IN ('A', 'B');""",
    "INSERT INTO dim.dim_customers SELECT INITCAP(TRIM(c.f || ' ' || c.l)) AS full_name, CASE WHEN c.v > 1 THEN 'x' ELSE 'y' END AS segment FROM source.customers c WHERE c.ok = TRUE",
    "INSERT INTO w.enriched_orders SELECT ro.id, (ro.unit_price - p.unit_cost) AS gross_margin FROM staging.raw_orders ro INNER JOIN source.products p ON ro.pid = p.id",
    "INSERT INTO w.daily_sales_summary SELECT eo.d, COUNT(DISTINCT eo.id) AS total_orders FROM w.enriched_orders eo JOIN dim.dim_customers c ON c.id = eo.cid GROUP BY eo.d",
    "INSERT INTO mart.sales_performance WITH rolling AS (SELECT *, SUM(r) OVER (PARTITION BY a ORDER BY d ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS s FROM w.daily_sales_summary) SELECT rw.d AS report_date, rw.s FROM rolling rw",
]

CASES = [
    # sql, [(target, sources, kind, ctes, mappings)]
    (RETAIL[0], [("raw_orders", ["orders"], "filter", [], [("order_id", "order_id"), ("order_status", "o.status"), ("region", "region"), ("extracted_at", "NOW()")])]),
    (RETAIL[1], [("dim_customers", ["customers"], "filter", [], [("full_name", "INITCAP(TRIM(c.f || ' ' || c.l))"), ("segment", "CASE WHEN c.v > 1 THEN 'x' ELSE 'y' END")])]),
    (RETAIL[2], [("enriched_orders", ["raw_orders", "products"], "join", [], [("id", "id"), ("gross_margin", "(ro.unit_price - p.unit_cost)")])]),
    (RETAIL[3], [("daily_sales_summary", ["enriched_orders", "dim_customers"], "aggregate", [], [("d", "d"), ("total_orders", "COUNT(DISTINCT eo.id)")])]),
    (RETAIL[4], [("sales_performance", ["daily_sales_summary"], "aggregate", ["rolling"], [("report_date", "rw.d"), ("s", "s")])]),
    ("INSERT INTO raw.events SELECT e.id FROM x.events e WHERE e.t != 'bot'", [("events", [], "filter", [], [("id", "id")])]),
    ("CREATE TABLE mart.sales AS SELECT * FROM warehouse.daily_summary", [("sales", ["daily_summary"], "passthrough", [], [("*", "*")])]),
    ("INSERT INTO a SELECT x FROM b; INSERT INTO c SELECT y FROM d", [("a", ["b"], "passthrough", [], [("x", "x")]), ("c", ["d"], "passthrough", [], [("y", "y")])]),
    ("", []), ("-- only\n/* remarks; */", []), ("SELECT 1; UPDATE t SET a = 1; DELETE FROM t; CREATE VIEW v AS SELECT 1", []), ("WITH a AS (SELECT 1) SELECT * FROM a", []),
    ("INSERT INTO t SELECT a.x FROM b a FULL OUTER JOIN c ON a.i = c.i NATURAL JOIN d", [("t", ["b", "c", "d"], "join", [], [("x", "x")])]),
    ("WITH p AS (SELECT * FROM r1), q AS (SELECT * FROM r2) INSERT INTO t SELECT p.*, q.v AS w FROM p JOIN q ON 1 = 1", [("t", ["r1", "r2"], "join", ["p", "q"], [("*", "*"), ("w", "q.v")])]),
    ("WITH RECURSIVE r(n) AS (SELECT 1 FROM seed UNION ALL SELECT n + 1 FROM r) INSERT INTO t SELECT n FROM r", [("t", ["seed"], "passthrough", ["r"], [("n", "n")])]),
    ("INSERT INTO t SELECT a FROM b WHERE a IN (SELECT a FROM c)", [("t", ["b", "c"], "join", [], [("a", "a")])]),
    ("INSERT INTO t SELECT d.a FROM (SELECT a FROM inside) d", [("t", ["inside"], "passthrough", [], [("a", "a")])]),
    ("INSERT INTO t (a) SELECT a FROM b", [("t", ["b"], "passthrough", [], [("a", "a")])]),
    ("CREATE OR REPLACE TABLE t AS SELECT a FROM b", [("t", ["b"], "passthrough", [], [("a", "a")])]),
    ('INSERT INTO "My Schema"."My Table" SELECT `a` FROM `x`.`Src`', [("My Table", ["Src"], "passthrough", [], [("a", "a")])]),
    ("INSERT INTO t SELECT 'FROM nowhere -- x' AS s FROM b -- JOIN c\n/* FROM d */", [("t", ["b"], "join", [], [("s", "'FROM nowhere -- x'")])]),
    ("INSERT INTO t SELECT a FROM b UNION ALL SELECT z FROM c", [("t", ["b", "c"], "join", [], [("a", "a")])]),
    ("INSERT INTO t SELECT EXTRACT(YEAR FROM d) AS y, TRIM(BOTH ' ' FROM s) v FROM b WHERE x IS DISTINCT FROM y", [("t", ["b"], "filter", [], [("y", "EXTRACT(YEAR FROM d)"), ("v", "TRIM(BOTH ' ' FROM s)")])]),
    ("CREATE TABLE IF NOT EXISTS s.t (id INT, v DECIMAL(10, 2))", [("t", [], "passthrough", [], [])]),
    ("INSERT INTO t SELECT a FROM B, b, C c, d WHERE 1 = 1", [("t", ["B", "C", "d"], "join", [], [("a", "a")])]),
    ("INSERT INTO t SELECT COUNT(*), MAX(a) AS m, 1, a + b, c FROM x", [("t", ["x"], "aggregate", [], [("m", "MAX(a)"), ("c", "c")])]),
]


def test_statements(spark):
    texts = spark.createDataFrame([(i, None, s) for i, (s, _) in enumerate(CASES)], "text_id long, pipeline_name string, sql string")
    got = {}
    for r in extract_sql(texts).orderBy("text_id", "stmt").collect():
        got.setdefault(r.text_id, []).append((r.target_table, r.source_tables, r.transformation_type, r.cte_names, [tuple(m) for m in r.column_mappings]))
    for i, (sql, want) in enumerate(CASES):
        assert got.get(i, []) == want, sql


def test_repeated_and_null_ids_and_null_texts(spark):
    rows = [(1, "p", "INSERT INTO a SELECT x FROM b"), (1, "p", "INSERT INTO c SELECT y FROM d; INSERT INTO e SELECT z FROM f"), (None, None, "INSERT INTO g SELECT w FROM h"), (2, "p", None)]
    got = sorted((r.target_table, r.source_tables, r.stmt, r.text_id) for r in extract_sql(spark.createDataFrame(rows, "text_id long, pipeline_name string, sql string")).collect())
    assert got == [("a", ["b"], 0, 1), ("c", ["d"], 0, 1), ("e", ["f"], 1, 1), ("g", ["h"], 0, None)]


def test_column_sources(spark):
    def of(sql, **k):
        return [(s.target_col, s.source_table, s.source_column) for s in parse_sql(spark, sql, **k).first().column_sources]

    assert of("INSERT INTO t SELECT o.x AS y, c.name n, o.a + c.b AS s, z FROM raw.orders o JOIN crm.customers AS c ON o.id = c.id") == [
        ("y", "orders", "x"), ("n", "customers", "name"), ("s", "orders", "a"), ("s", "customers", "b"), ("z", None, "z")]
    assert of("INSERT INTO t SELECT COUNT(DISTINCT v) AS n, CAST(w AS INT) AS w, CASE WHEN k > 'x' THEN NULL ELSE orders.q END AS c FROM Orders") == [("n", "Orders", "v"), ("w", "Orders", "w"), ("c", "Orders", "k"), ("c", "Orders", "q")]
    assert of("INSERT INTO t SELECT d.a, b.* FROM (SELECT a FROM x) d, s.b", qualified=True) == [("a", None, "a"), ("*", "s.b", "*")]
    assert of("INSERT INTO t SELECT a FROM b UNION ALL SELECT z FROM c") == [("a", "b", "a")]
    assert of("INSERT INTO t SELECT TRIM(BOTH ' ' FROM s) v, EXTRACT(YEAR FROM d) AS y, 'a.b' AS l FROM x") == [("v", "x", "s"), ("y", "x", "d")]
    assert of("CREATE TABLE t (id INT)") == []


def test_a_long_statement_takes_time_in_proportion():
    sql = "INSERT INTO t SELECT " + ", ".join(f"f(g(a{i}), b) AS c{i}" for i in range(20_000)) + " FROM x"
    t = time.perf_counter()
    assert len(parse_statement(sql)["column_mappings"]) == 20_000 and time.perf_counter() - t < 6
    assert [n for n, _ in split_statements('SELECT 1;; SELECT 2 -- ;\n; -- none\n;')] == [0, 2]


def test_pipeline_name_star_and_qualified(spark):
    sql = "INSERT INTO staging.orders SELECT * FROM source.orders"
    r = parse_sql(spark, sql, "daily", star=False, qualified=True).first()
    assert (r.pipeline_name, r.target_table, r.source_tables, r.column_mappings, r.raw_sql) == ("daily", "staging.orders", ["source.orders"], [], sql)
    assert parse_sql(spark, sql).first().source_tables == []


@pytest.mark.parametrize("sql", ["INSERT INTO t SELECT a FROM b JOIN c ON b.x = c.x", "CREATE TABLE t AS SELECT a FROM b LEFT JOIN c USING (x) CROSS JOIN d", "INSERT INTO t WITH q AS (SELECT a FROM b) SELECT a FROM q"])
def test_sources_agree_with_sparks_own_parser(spark, sql):
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    for table in parse_sql(spark, sql).first().source_tables:
        assert f"UnresolvedRelation [{table}]" in plan
