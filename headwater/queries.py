"""Queries of the lineage engine over the tables of a folder, and their SQL twins.

The tables hold no pipeline code, so two generators make some from keys: a provenance graph from the foreign keys
(region > nation > customer > orders > part, nation > supplier > part: trees, diamonds and four systems), and a corpus of
SQL, dbt, script and task texts, one for each row of a table. What the operators must find in them is a formula over the
same rows, which the SQL twins state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators import dbt_extract, graph, impact, merge, report, script_extract, service, sql_extract, store
from headwater.plans.stages import materialise, spread
from headwater.sources.files import airflow_tasks

TABLES = "region nation customer supplier part orders lineitem events".split()

# Both dialects read these two.
NODES = """
SELECT 'region::' || r_regionkey AS node, 'airflow' AS system, 'AirflowTask' AS node_type, CAST(0 AS BIGINT) AS lvl, CAST(r_regionkey AS BIGINT) AS k FROM region
UNION ALL SELECT 'nation::' || n_nationkey, 'sql', 'SourceTable', CAST(1 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 'customer::' || c_custkey, 'spark', 'SparkDataset', CAST(2 AS BIGINT), CAST(c_custkey AS BIGINT) FROM customer
UNION ALL SELECT 'supplier::' || s_suppkey, 'spark', 'SparkDataset', CAST(3 AS BIGINT), CAST(s_suppkey AS BIGINT) FROM supplier
UNION ALL SELECT 'orders::' || o_orderkey, 'dbt', 'DbtModel', CAST(4 AS BIGINT), CAST(o_orderkey AS BIGINT) FROM orders
UNION ALL SELECT 'part::' || p_partkey, 'sql', 'SinkTable', CAST(5 AS BIGINT), CAST(p_partkey AS BIGINT) FROM part"""
EDGES = """
SELECT 'region::' || n_regionkey AS src, 'nation::' || n_nationkey AS dst, 'airflow' AS system, CAST(1 AS BIGINT) AS lvl, CAST(n_regionkey AS BIGINT) AS a, CAST(n_nationkey AS BIGINT) AS b FROM nation
UNION ALL SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey, 'sql', CAST(2 AS BIGINT), CAST(c_nationkey AS BIGINT), CAST(c_custkey AS BIGINT) FROM customer
UNION ALL SELECT 'nation::' || s_nationkey, 'supplier::' || s_suppkey, 'sql', CAST(3 AS BIGINT), CAST(s_nationkey AS BIGINT), CAST(s_suppkey AS BIGINT) FROM supplier
UNION ALL SELECT 'customer::' || o_custkey, 'orders::' || o_orderkey, 'spark', CAST(4 AS BIGINT), CAST(o_custkey AS BIGINT), CAST(o_orderkey AS BIGINT) FROM orders
UNION ALL SELECT 'supplier::' || l_suppkey, 'part::' || l_partkey, 'cross', CAST(5 AS BIGINT), CAST(l_suppkey AS BIGINT), CAST(l_partkey AS BIGINT) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x
UNION ALL SELECT 'orders::' || l_orderkey, 'part::' || l_partkey, 'dbt', CAST(6 AS BIGINT), CAST(l_orderkey AS BIGINT), CAST(l_partkey AS BIGINT) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) y"""
_PAIR = "named_struct('target_col', '{}', 'source_expression', '{}')"
MAPPINGS = f"""CASE b % 5 WHEN 0 THEN array({_PAIR.format('amount', 'price*amount')}) WHEN 1 THEN array({_PAIR.format('*', '*')})
  WHEN 2 THEN array({_PAIR.format('id', 'id')}, {_PAIR.format('total', 'SUM(amount)')}) WHEN 3 THEN array({_PAIR.format('id', 'customer_id')}) ELSE array({_PAIR.format('*', 'x')}) END"""


#: Rows of a table whose texts one task reads.
TEXTS = 50_000


def _views(spark: SparkSession, sf_dir: str, sql: str, rows: int | None = None) -> DataFrame:
    """``sql`` over the tables; with ``rows``, their rows are dealt out so that texts made of them lie in many tasks."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql}
    if rows:
        frames = {t: spread(f, rows) if f"FROM {t}" in sql else f for t, f in frames.items()}
    for t in sorted(frames, key=len, reverse=True):
        for before in ("FROM ", "JOIN "):
            sql = sql.replace(f"{before}{t} ", f"{before}{{{t}}} ").replace(f"{before}{t})", f"{before}{{{t}}})").replace(f"{before}{t}\n", f"{before}{{{t}}}\n")
        if sql.endswith(f"FROM {t}"):
            sql = sql[: -len(t)] + f"{{{t}}}"
    return spark.sql(sql, **{t: f for t, f in frames.items() if f"{{{t}}}" in sql})


def provenance(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unified nodes and edges of the foreign-key graph."""
    nodes = _views(spark, sf_dir, NODES).selectExpr("node", "node AS label", "system", "node_type", "CAST(map() AS map<string,string>) AS metadata", "array(lvl, k) AS seq", "lvl = 0 AS is_source")
    edges = _views(spark, sf_dir, EDGES).selectExpr("src", "dst", "system", "CASE WHEN lvl = 1 THEN '' ELSE system END AS transformation_type", f"{MAPPINGS} AS column_mappings", "CAST(NULL AS STRING) AS pipeline_name", "CAST(NULL AS STRING) AS shared_path", "array(lvl, a, b) AS seq")
    return nodes, edges


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- extraction ---------------------------------------------------------------------------------------------------

_STATEMENTS = """
SELECT o_orderkey AS text_id, CASE WHEN o_orderkey % 2 = 0 THEN 'etl' END AS pipeline_name, CASE o_orderkey % 8
  WHEN 0 THEN 'INSERT INTO mart.t' || o_orderkey || ' SELECT o.id, o.x AS y FROM raw.src' || o_custkey || ' o'
  WHEN 1 THEN 'INSERT INTO t' || o_orderkey || ' (id) SELECT id FROM src' || o_custkey || ' WHERE note <> ''FROM nowhere''; -- a remark'
  WHEN 2 THEN 'CREATE TABLE IF NOT EXISTS mart.t' || o_orderkey || ' AS SELECT a.id, (a.p - b.q) AS margin FROM raw.src' || o_custkey || ' a FULL OUTER JOIN dim b ON a.id = b.id'
  WHEN 3 THEN 'INSERT INTO t' || o_orderkey || ' SELECT k, COUNT(DISTINCT v) AS n FROM src' || o_custkey || ', Dim d, dim GROUP BY k'
  WHEN 4 THEN 'WITH c1 AS (SELECT * FROM src' || o_custkey || '), c2 AS (SELECT * FROM dim) INSERT INTO t' || o_orderkey || ' SELECT * FROM c1 JOIN c2 ON c1.a = c2.a'
  WHEN 5 THEN 'SELECT 1; UPDATE x SET a = 1; CREATE OR REPLACE TABLE t' || o_orderkey || ' AS SELECT s.* FROM (SELECT EXTRACT(YEAR FROM d) FROM src' || o_custkey || ') s'
  WHEN 6 THEN '/* none */ INSERT INTO t' || o_orderkey || ' SELECT TRIM(a || b) AS f FROM t' || o_orderkey || ' WHERE k IN (SELECT k FROM src' || o_custkey || ') UNION ALL SELECT z FROM dim'
  ELSE 'CREATE TABLE "T".t' || o_orderkey || ' (id INT)' END AS sql FROM orders"""

_SQL_RECORDS = """
SELECT o_orderkey AS text_id, CAST(CASE o_orderkey % 8 WHEN 5 THEN 2 ELSE 0 END AS INTEGER) AS stmt, 't' || o_orderkey AS target_table,
  CASE o_orderkey % 8 WHEN 0 THEN 'src' || o_custkey WHEN 1 THEN 'src' || o_custkey WHEN 5 THEN 'src' || o_custkey WHEN 7 THEN ''
    WHEN 3 THEN 'src' || o_custkey || ',Dim' ELSE 'src' || o_custkey || ',dim' END AS sources,
  CASE o_orderkey % 8 WHEN 0 THEN 'id<id;y<o.x' WHEN 1 THEN 'id<id' WHEN 2 THEN 'id<id;margin<(a.p - b.q)' WHEN 3 THEN 'k<k;n<COUNT(DISTINCT v)' WHEN 4 THEN '*<*' WHEN 5 THEN '*<*'
    WHEN 6 THEN 'f<TRIM(a || b)' ELSE '' END AS mappings,
  CASE o_orderkey % 8 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'filter' WHEN 2 THEN 'join' WHEN 3 THEN 'aggregate' WHEN 4 THEN 'join' WHEN 5 THEN 'passthrough' WHEN 6 THEN 'join' ELSE 'passthrough' END AS kind,
  CASE WHEN o_orderkey % 2 = 0 THEN 'etl' ELSE '' END AS pipeline, CASE o_orderkey % 8 WHEN 4 THEN 'c1,c2' ELSE '' END AS ctes
FROM orders"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_extract.extract_sql(_views(spark, sf_dir, _STATEMENTS, TEXTS))


def _kept_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph needs of the records, read once."""
    return materialise(_records(spark, sf_dir).drop("raw_sql", "cte_names", "column_sources"))


@query(_SQL_RECORDS)
def sql_records(spark, sf_dir):
    return _records(spark, sf_dir).selectExpr(
        "text_id", "stmt", "target_table", "array_join(source_tables, ',') AS sources", "array_join(transform(column_mappings, m -> m.target_col || '<' || m.source_expression), ';') AS mappings",
        "transformation_type AS kind", "coalesce(pipeline_name, '') AS pipeline", "array_join(cte_names, ',') AS ctes",
    )


@query("""SELECT text_id, s[1] AS target_col, s[2] AS source_table, s[3] AS source_column FROM (SELECT o_orderkey AS text_id, unnest(CASE o_orderkey % 8
  WHEN 0 THEN [['id', 'src' || o_custkey, 'id'], ['y', 'src' || o_custkey, 'x']] WHEN 1 THEN [['id', 'src' || o_custkey, 'id']]
  WHEN 2 THEN [['id', 'src' || o_custkey, 'id'], ['margin', 'src' || o_custkey, 'p'], ['margin', 'dim', 'q']] WHEN 3 THEN [['k', '', 'k'], ['n', '', 'v']]
  WHEN 4 THEN [['*', 'c1', '*'], ['*', 'c2', '*']] WHEN 5 THEN [['*', '', '*']] WHEN 6 THEN [['f', 't' || o_orderkey, 'a'], ['f', 't' || o_orderkey, 'b']] ELSE [] END) AS s FROM orders) x""")
def column_sources(spark, sf_dir):
    return _records(spark, sf_dir).selectExpr("text_id", "inline(column_sources)").withColumn("source_table", F.coalesce("source_table", F.lit("")))


@query(f"WITH r AS ({_SQL_RECORDS}) SELECT kind, count(*) AS n FROM r GROUP BY kind")
def sql_kinds(spark, sf_dir):
    return _records(spark, sf_dir).groupBy(F.col("transformation_type").alias("kind")).agg(F.count("*").alias("n"))


_SQL_EDGES = f"SELECT src, target_table AS dst, kind FROM (SELECT *, unnest(string_split(sources, ',')) AS src FROM ({_SQL_RECORDS}) r WHERE sources <> '') u"


@query(f"""SELECT node, NOT bool_or(fed) AS is_source FROM (SELECT target_table AS node, sources <> '' AS fed FROM ({_SQL_RECORDS}) r UNION ALL SELECT src, false FROM ({_SQL_EDGES}) e) x GROUP BY node""")
def sql_graph_nodes(spark, sf_dir):
    return graph.graph_of(_records(spark, sf_dir), "-")[0].select("node", "is_source")


@query(f"SELECT src, dst, kind FROM ({_SQL_EDGES}) e")
def sql_graph_edges(spark, sf_dir):
    return graph.graph_of(_records(spark, sf_dir), "-")[1].select("src", "dst", F.col("transformation_type").alias("kind"))


@query(f"""SELECT count(DISTINCT node) AS tables_added, (SELECT count(*) FROM ({_SQL_EDGES}) e WHERE CAST(substr(dst, 2) AS BIGINT) % 2 = 1) AS edges_added
FROM (SELECT target_table AS node, text_id % 2 AS odd FROM ({_SQL_RECORDS}) r UNION ALL SELECT src, CAST(substr(dst, 2) AS BIGINT) % 2 FROM ({_SQL_EDGES}) e) x
WHERE odd = 1 AND node NOT IN (SELECT target_table FROM ({_SQL_RECORDS}) r WHERE text_id % 2 = 0 UNION ALL SELECT src FROM ({_SQL_EDGES}) e WHERE CAST(substr(dst, 2) AS BIGINT) % 2 = 0)""")
def ingest_delta(spark, sf_dir):
    r = _kept_records(spark, sf_dir)
    before = graph.graph_of(r.where("text_id % 2 = 0"), "-")
    return graph.ingest_delta(before, graph.ingest(*before, r.where("text_id % 2 = 1")))


_MODELS = """
SELECT 'm' || p_partkey AS model_name, p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '{{ config(materialized=''table'') }} ' WHEN 1 THEN '{{ config( tags=[''x''], materialized = "incremental") }} ' ELSE '' END ||
  'SELECT id, ROUND(price, 2) AS amount, t.region FROM {{ ref(''m' || (p_partkey - 1) || ''') }} t' ||
  CASE WHEN p_partkey % 2 = 0 THEN ' JOIN {{ source("raw", "s' || p_size || '") }} USING (id)' ELSE '' END AS sql FROM part"""


@query("""SELECT 'm' || p_partkey AS model_name, 'analytics.public.m' || p_partkey AS warehouse_table, 'm' || (p_partkey - 1) AS refs,
  CASE WHEN p_partkey % 2 = 0 THEN 'raw.s' || p_size ELSE '' END AS sources, CASE p_partkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'incremental' ELSE 'view' END AS materialization,
  'id<id;amount<ROUND(price, 2);region<t.region' AS mappings, 'm' || (p_partkey - 1) || CASE WHEN p_partkey % 2 = 0 THEN ',raw.s' || p_size ELSE '' END AS all_upstream FROM part""")
def dbt_models(spark, sf_dir):
    m = dbt_extract.all_upstream(dbt_extract.parse_dbt_models(_views(spark, sf_dir, _MODELS.replace("{", "{{").replace("}", "}}"), TEXTS)))
    return m.selectExpr(
        "model_name", "warehouse_table", "array_join(ref_deps, ',') AS refs", "array_join(transform(source_deps, s -> s.source_name || '.' || s.table_name), ',') AS sources", "materialization",
        "array_join(transform(column_lineage, c -> c.target_col || '<' || c.source_expression), ';') AS mappings", "array_join(all_upstream, ',') AS all_upstream",
    )


@query("SELECT 'm' || p_partkey AS model_name, 'm' || (p_partkey - 1) AS refs FROM part")
def dbt_dependencies(spark, sf_dir):
    m = dbt_extract.parse_dbt_models(_views(spark, sf_dir, _MODELS.replace("{", "{{").replace("}", "}}"), TEXTS))
    return dbt_extract.dependencies(m).selectExpr("model_name", "array_join(ref_deps, ',') AS refs")


@query("SELECT 'm' || (p_partkey % 50) AS model_name, 'm' || (max(p_partkey) - 1) AS refs FROM part GROUP BY p_partkey % 50")
def dbt_repeated_names(spark, sf_dir):
    """Models of one name: the last one counts."""
    models = _views(spark, sf_dir, _MODELS.replace("{", "{{").replace("}", "}}"), TEXTS).selectExpr("'m' || (k % 50) AS model_name", "sql", "k AS ord")
    return dbt_extract.dependencies(dbt_extract.parse_dbt_models(models), "ord").selectExpr("model_name", "array_join(ref_deps, ',') AS refs")


_SCRIPTS = r"""
SELECT 'p' || s_suppkey AS pipeline_name, s_suppkey AS ord, 'a = spark.read.parquet("s3://lake/a' || s_suppkey || '/")\nb = spark.read.format("csv").load("s3://lake/b' || (s_suppkey % 10) || '")\n' ||
  'c = a.filter("x > 1").select("id", "x")\nd = c.join(b, on="id", how="left").groupBy("id").agg({"x": "sum"})\n' ||
  CASE WHEN s_suppkey % 2 = 0 THEN 'd.write.mode("overwrite").parquet("s3://lake/out' || s_suppkey || '")\n' ELSE 'd.write.saveAsTable("mart.out' || s_suppkey || '")\n' END AS code FROM supplier"""


def _scripts(spark, sf_dir) -> DataFrame:
    code = _views(spark, sf_dir, _SCRIPTS.replace("{", "{{").replace("}", "}}"), TEXTS)
    return script_extract.parse_scripts(code).withColumn("ord", F.substring("pipeline_name", 2, 20).cast("bigint"))


@query("""SELECT 'p' || s_suppkey AS pipeline_name, 's3://lake/a' || s_suppkey || '/:parquet,s3://lake/b' || (s_suppkey % 10) || ':csv' AS sources,
  CASE WHEN s_suppkey % 2 = 0 THEN 's3://lake/out' || s_suppkey || ':parquet' ELSE 'mart.out' || s_suppkey || ':table' END AS sinks,
  'select(a)->c,filter(a)->,agg(c)->d,groupBy(c)->,join(c+b)->' AS steps, 'c' AS vars, 'left' AS how FROM supplier""")
def script_records(spark, sf_dir):
    return _scripts(spark, sf_dir).selectExpr(
        "pipeline_name", "array_join(transform(sources, s -> s.path || ':' || s.format), ',') AS sources", "array_join(transform(sinks, s -> s.path || ':' || s.format), ',') AS sinks",
        "array_join(transform(transformations, t -> t.operation || '(' || array_join(t.input_vars, '+') || ')->' || coalesce(t.output_var, '')), ',') AS steps", "array_join(intermediate_vars, ',') AS vars",
        "filter(transformations, t -> t.operation = 'join')[0].details.how AS how",
    )


_CALLS = r"""
SELECT 'q' || s_suppkey AS pipeline_name, 'base = "s3://lake"\na = spark.read.table("raw.t' || s_suppkey || '")\nb = spark.read.csv(base, "id INT")\n' ||
  'c = a.union(b).select("id", "x").withColumn("y' || s_suppkey || '", col("x"))\nd = c.groupBy("id", "x").count()\nc.write.parquet(base, "overwrite")\nd.write.json(path="s3://lake/d' || s_suppkey || '")\n' AS code FROM supplier"""


@query("""SELECT 'q' || s_suppkey AS pipeline_name, 'raw.t' || s_suppkey || ',<unknown_csv>' AS sources, '<unknown_parquet>,s3://lake/d' || s_suppkey AS sinks,
  'withColumn(a)[y' || s_suppkey || ']c,select(a)[id+x],union(a+b)[],groupBy(c)[id+x]d' AS steps FROM supplier""")
def script_calls(spark, sf_dir):
    """Tables, paths in variables, schemas and modes behind them, unions, columns of select, groupBy and withColumn."""
    records = script_extract.paths(script_extract.parse_scripts(_views(spark, sf_dir, _CALLS, TEXTS)))
    return records.selectExpr(
        "pipeline_name", "array_join(source_paths, ',') AS sources", "array_join(sink_paths, ',') AS sinks",
        """array_join(transform(transformations, t -> t.operation || '(' || array_join(t.input_vars, '+') || ')[' ||
          coalesce(t.details.column, array_join(coalesce(t.details.columns, t.details.group_by), '+'), '') || ']' || coalesce(t.output_var, '')), ',') AS steps""",
    )


# --- merged graph ---------------------------------------------------------------------------------------------------


def _tasks(spark, sf_dir) -> DataFrame:
    rows = _views(spark, sf_dir, """SELECT 'dag' || (s_suppkey % 7) AS dag_id, 'task' || s_suppkey AS task_id, CAST(NULL AS STRING) AS operator, array('S3://LAKE/a' || s_suppkey) AS input_paths,
      array('s3://lake/out' || s_suppkey || '/') AS output_paths, array('task' || (s_suppkey - 7), 'task' || (s_suppkey - 1)) AS upstream_task_ids, s_suppkey AS ord FROM supplier""")
    return airflow_tasks(rows).join(rows.select("dag_id", "task_id", "ord"), ["dag_id", "task_id"])


def systems(spark: SparkSession, sf_dir: str) -> merge.Unified:
    """All systems of the corpus, without cross edges."""
    none = merge.Unified.empty(spark)
    models = dbt_extract.parse_dbt_models(_views(spark, sf_dir, _MODELS.replace("{", "{{").replace("}", "}}"), TEXTS))
    return merge.together(
        merge.add_sql(none, *graph.graph_of(_kept_records(spark, sf_dir), "-")),
        merge.add_spark(none, materialise(_scripts(spark, sf_dir))),
        merge.add_dbt(none, materialise(models.withColumn("ord", F.substring("model_name", 2, 20).cast("bigint")))),
        merge.add_airflow(none, _tasks(spark, sf_dir)),
    )


def unified(spark: SparkSession, sf_dir: str) -> merge.Unified:
    """All systems of the corpus with their cross edges."""
    u = systems(spark, sf_dir)
    return merge.with_cross_edges(merge.Unified(u.nodes, materialise(u.edges), materialise(u.paths)))


_U_NODES = f"""SELECT node, 'sql' AS system, CASE WHEN bool_or(fed) THEN 'SinkTable' ELSE 'SourceTable' END AS node_type FROM (SELECT target_table AS node, sources <> '' AS fed FROM ({_SQL_RECORDS}) r UNION ALL SELECT src, false FROM ({_SQL_EDGES}) e) x GROUP BY node
UNION ALL SELECT DISTINCT unnest(['spark::s3://lake/a' || s_suppkey || '/', 'spark::s3://lake/b' || (s_suppkey % 10), CASE WHEN s_suppkey % 2 = 0 THEN 'spark::s3://lake/out' || s_suppkey ELSE 'spark::mart.out' || s_suppkey END, 'spark::c', 'spark::b']), 'spark', 'SparkDataset' FROM supplier
UNION ALL SELECT 'dbt::m' || p_partkey, 'dbt', 'DbtModel' FROM part
UNION ALL SELECT DISTINCT 'dbt::m' || (p_partkey - 1), 'dbt', 'DbtModel' FROM part WHERE p_partkey - 1 NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT DISTINCT 'dbt::source::raw.s' || p_size, 'dbt', 'SourceTable' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'airflow::dag' || (s_suppkey % 7) || '.task' || s_suppkey, 'airflow', 'AirflowTask' FROM supplier"""
_U_CROSS = """SELECT 'airflow::dag' || (s_suppkey % 7) || '.task' || s_suppkey AS src, 'spark::s3://lake/a' || s_suppkey || '/' AS dst, 's3://lake/a' || s_suppkey AS shared_path FROM supplier
UNION ALL SELECT 'airflow::dag' || (s_suppkey % 7) || '.task' || s_suppkey, 'spark::s3://lake/out' || s_suppkey, 's3://lake/out' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0"""
_U_EDGES = f"""SELECT src, dst, 'sql' AS system FROM ({_SQL_EDGES}) e
UNION ALL SELECT unnest(['spark::s3://lake/a' || s_suppkey || '/', 'spark::s3://lake/b' || (s_suppkey % 10)]), CASE WHEN s_suppkey % 2 = 0 THEN 'spark::s3://lake/out' || s_suppkey ELSE 'spark::mart.out' || s_suppkey END, 'spark' FROM supplier
UNION ALL SELECT 'dbt::m' || (p_partkey - 1), 'dbt::m' || p_partkey, 'dbt' FROM part
UNION ALL SELECT 'dbt::source::raw.s' || p_size, 'dbt::m' || p_partkey, 'dbt' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'airflow::dag' || (s_suppkey % 7) || '.task' || (s_suppkey - 7), 'airflow::dag' || (s_suppkey % 7) || '.task' || s_suppkey, 'airflow' FROM supplier WHERE s_suppkey - 7 IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT src, dst, 'cross' FROM ({_U_CROSS}) c"""


@query(_U_NODES)
def unified_nodes(spark, sf_dir):
    return systems(spark, sf_dir).nodes.select("node", "system", "node_type")


@query(_U_EDGES)
def unified_edges(spark, sf_dir):
    return unified(spark, sf_dir).edges.select("src", "dst", "system")


@query(_U_CROSS)
def cross_edges(spark, sf_dir):
    return unified(spark, sf_dir).edges.where("system = 'cross'").select("src", "dst", "shared_path")


@query(f"""SELECT system, coalesce(n, 0) AS nodes, coalesce(e, 0) AS edges, coalesce(types, '') AS types FROM (SELECT unnest(['airflow', 'sql', 'spark', 'dbt']) AS system) s
LEFT JOIN (SELECT system, CAST(sum(k) AS BIGINT) AS n, string_agg(node_type || ': ' || k, ', ' ORDER BY node_type) AS types FROM (SELECT system, node_type, count(*) AS k FROM ({_U_NODES}) x GROUP BY ALL) y GROUP BY system) n USING (system)
LEFT JOIN (SELECT system, count(*) AS e FROM ({_U_EDGES}) z GROUP BY system) e USING (system)""")
def system_comparison(spark, sf_dir):
    u = unified(spark, sf_dir)
    return merge.comparison(u.nodes, u.edges)


@query(f"SELECT (SELECT count(*) FROM ({_U_NODES}) n WHERE node_type = 'SourceTable') AS source_tables, (SELECT count(*) FROM ({_U_CROSS}) c) AS cross_edges")
def unified_counts(spark, sf_dir):
    u = unified(spark, sf_dir)
    return merge.counts(u.nodes, u.edges)


# --- questions to the graph ------------------------------------------------------------------------------------------

_FK = f"WITH RECURSIVE n AS ({NODES}), e AS ({EDGES})"


@query(f"SELECT system, count(*) AS n FROM ({NODES}) x GROUP BY system")
def coverage_stats(spark, sf_dir):
    return merge.coverage(provenance(spark, sf_dir)[0])


@query(f"""{_FK}, r AS (SELECT 'part::1' AS node, 0 AS hop UNION SELECT e.src, r.hop + 1 FROM r JOIN e ON e.dst = r.node)
SELECT node, CAST(min(hop) AS INTEGER) AS hop, min(hop) = 1 AS direct, any_value(n.system) AS system FROM r JOIN n USING (node) WHERE node <> 'part::1' GROUP BY node""")
def upstream(spark, sf_dir):
    return graph.upstream(*provenance(spark, sf_dir), "part::1").select("node", "hop", "direct", "system")


@query(f"""{_FK}, r AS (SELECT 'nation::3' AS node, 0 AS hop UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node)
SELECT node, CAST(min(hop) AS INTEGER) AS hop, min(hop) = 1 AS direct, any_value(n.system) AS system FROM r JOIN n USING (node) WHERE node <> 'nation::3' GROUP BY node""")
def downstream(spark, sf_dir):
    return graph.downstream(*provenance(spark, sf_dir), "nation::3").select("node", "hop", "direct", "system")


@query(f"""{_FK}, r AS (SELECT 'nation::3' AS node, 0 AS hop, ['nation::3'] AS path UNION ALL SELECT e.dst, r.hop + 1, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node)
SELECT node, CAST(min(hop) AS INTEGER) AS hop, array_to_string(arg_min(path, (hop, path)), ' > ') AS path FROM r WHERE hop > 0 GROUP BY node""")
def impact_paths(spark, sf_dir):
    return graph.impact_analysis(provenance(spark, sf_dir)[1], "nation::3").selectExpr("node", "hop", "array_join(path, ' > ') AS path")


@query(f"""{_FK}, r AS (SELECT node, 0 AS depth FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node) SELECT node, CAST(max(depth) AS INTEGER) AS level FROM r JOIN n USING (node) GROUP BY node""")
def topo_levels(spark, sf_dir):
    return graph.topological_order(*provenance(spark, sf_dir)).select("node", "level")


@query(f"""{_FK}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst),
u AS (SELECT dst AS node, count(*) AS k FROM c GROUP BY dst), d AS (SELECT src AS node, count(*) AS k FROM c GROUP BY src)
SELECT node, coalesce(u.k, 0) AS upstream_count, coalesce(d.k, 0) AS downstream_count FROM n LEFT JOIN u USING (node) LEFT JOIN d USING (node)""")
def closure_counts(spark, sf_dir):
    return graph.closure_counts(*provenance(spark, sf_dir))


_DECODE = "CASE b % 5 WHEN 0 THEN [('amount', 'price*amount')] WHEN 1 THEN [('*', '*')] WHEN 2 THEN [('id', 'id'), ('total', 'SUM(amount)')] WHEN 3 THEN [('id', 'customer_id')] ELSE [('*', 'x')] END"


@query(f"SELECT m[1] AS target_col, m[2] AS source_expression FROM (SELECT unnest({_DECODE}) AS m FROM ({EDGES}) e WHERE src = 'nation::3' AND dst IN (SELECT 'customer::' || min(c_custkey) FROM customer WHERE c_nationkey = 3)) x")
def edge_lookup(spark, sf_dir):
    first = _views(spark, sf_dir, "SELECT 'customer::' || min(c_custkey) AS dst FROM customer WHERE c_nationkey = 3").first()["dst"]
    return graph.edge_lineage(provenance(spark, sf_dir)[1], "nation::3", first)


@query(f"""{_FK}, r AS (SELECT 'nation::3' AS node, ['nation::3'] AS path UNION ALL SELECT e.dst, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node)
SELECT array_to_string(path, ' > ') AS path FROM r WHERE node = 'part::1'""")
def simple_paths(spark, sf_dir):
    return graph.end_to_end_paths(provenance(spark, sf_dir)[1], "nation::3", "part::1").selectExpr("array_join(path, ' > ') AS path")


@query("SELECT string_agg('dbt::m' || k, ' > ' ORDER BY k) AS path FROM range(61) r(k) WHERE (SELECT count(*) FROM part WHERE p_partkey BETWEEN 1 AND 60) = 60 HAVING count(*) > 0")
def chain_paths(spark, sf_dir):
    """A path of sixty edges through the models."""
    models = dbt_extract.parse_dbt_models(_views(spark, sf_dir, _MODELS.replace("{", "{{").replace("}", "}}")).withColumnRenamed("k", "ord"))
    u = merge.add_dbt(merge.Unified.empty(spark), models)
    return merge.end_to_end_paths(u, "dbt::m0", "dbt::m60").selectExpr("array_join(path, ' > ') AS path")


@query(f"SELECT node, system, node_type FROM ({NODES}) x WHERE node = 'nation::7'")
def node_attributes(spark, sf_dir):
    return graph.node_metadata(provenance(spark, sf_dir)[0], "nation::7").select("node", "system", "node_type")


@query(f"SELECT node FROM ({NODES}) x")
def table_names(spark, sf_dir):
    return graph.all_tables(provenance(spark, sf_dir)[0])


@query(f"SELECT 'node' AS kind, node AS a, system AS b FROM ({NODES}) n UNION ALL SELECT 'edge', src, dst FROM ({EDGES}) e")
def graph_json(spark, sf_dir):
    lines = graph.as_json(*provenance(spark, sf_dir))
    return lines.selectExpr("kind", "coalesce(get_json_object(json, '$.node'), get_json_object(json, '$.src')) AS a", "if(kind = 'node', get_json_object(json, '$.system'), get_json_object(json, '$.dst')) AS b")


@query(f"SELECT src, dst FROM ({_U_EDGES}) e WHERE system = 'dbt'")
def subgraph_edges(spark, sf_dir):
    return merge.subgraph(unified(spark, sf_dir), "dbt")[1].select("src", "dst")


@query(f"SELECT node FROM ({NODES}) x WHERE system = 'spark'")
def nodes_by_system(spark, sf_dir):
    nodes, edges = provenance(spark, sf_dir)
    return merge.nodes_by_system(merge.Unified(nodes, edges, edges), "spark").select("node")


# --- impact ------------------------------------------------------------------------------------------------------------


def _blast_sql(tail: str, depth: int = 5) -> str:
    """The traversal with first-parent order, level by level; a change is (id, node, column, type)."""
    hit, wild = "(b % 5 IN (0, 2))", "(b % 5 IN (1, 4))"
    expr, target = "CASE b % 5 WHEN 0 THEN 'price*amount' ELSE 'SUM(amount)' END", "CASE b % 5 WHEN 0 THEN 'amount' ELSE 'total' END"
    out = f"""{_FK.replace('RECURSIVE ', '')}, ch AS (SELECT * FROM (VALUES ('0', 'nation::3', 'amount', 'rename'), ('1', 'nation::4', NULL, 'drop'), ('2', 'region::1', 'amount', 'type_change'), ('3', 'nowhere', 'amount', 'drop'), ('4', 'nation::3', 'zzz', 'add')) t(change_id, root, col, kind)),
    l0 AS (SELECT change_id, root AS node, col, kind, [root] AS path, CAST([] AS BIGINT[]) AS key, 'BREAKING' AS severity, '' AS reason, 0 AS hop FROM ch WHERE root IN (SELECT node FROM n)), s0 AS (SELECT change_id, node FROM l0)"""
    for i in range(1, depth + 1):
        used = f"(col = 'amount' AND {hit})"
        out += f""", x{i} AS (SELECT * FROM (SELECT l.change_id, e.dst AS node, col, kind, list_append(l.path, e.dst) AS path, list_concat(l.key, [e.lvl, e.a, e.b]) AS key, b,
          row_number() OVER (PARTITION BY l.change_id, e.dst ORDER BY list_concat(l.key, [e.lvl, e.a, e.b])) AS first
          FROM l{i - 1} l JOIN e ON e.src = l.node ANTI JOIN s{i - 1} s ON s.change_id = l.change_id AND s.node = e.dst WHERE l.severity <> 'OK') y WHERE first = 1),
        l{i} AS (SELECT change_id, node, col, kind, path, key,
          CASE WHEN col IS NULL OR {used} AND kind IN ('drop', 'rename') THEN 'BREAKING' WHEN {used} OR {wild} OR {i} <= 2 THEN 'WARNING' ELSE 'OK' END AS severity,
          CASE WHEN col IS NULL THEN 'Whole-table change (' || kind || ') propagates downstream' WHEN {used} AND kind = 'drop' THEN 'Column ''' || col || ''' is dropped; consumed in ''' || {target} || ''''
            WHEN {used} AND kind = 'rename' THEN 'Column ''' || col || ''' renamed; mapping ''' || {expr} || ''' → ''' || {target} || ''' will break'
            WHEN {used} AND kind = 'type_change' THEN 'Column ''' || col || ''' type changed; expression ''' || {expr} || ''' may be incompatible'
            WHEN {used} THEN 'Column ''' || col || ''' modified; review mapping ''' || {expr} || ''''
            WHEN b % 5 = 1 THEN 'Wildcard SELECT * — may implicitly include ''' || col || '''' WHEN b % 5 = 4 THEN 'Wildcard SELECT * — column ''' || col || ''' may be consumed'
            WHEN {i} <= 2 THEN 'Indirect consumer at hop {i}; review for implicit dependency on ''' || col || '''' ELSE 'No direct dependency on ''' || col || ''' detected at hop {i}' END AS reason, {i} AS hop FROM x{i}),
        s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT change_id, node FROM l{i})"""
    levels = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, depth + 1))
    return out + f""", imp AS (SELECT l.*, n.system, n.node_type, round(CASE n.system WHEN 'spark' THEN 2.5 WHEN 'dbt' THEN 0.5 WHEN 'airflow' THEN 1.5 ELSE 1.0 END
      * CASE severity WHEN 'BREAKING' THEN 1.0 WHEN 'WARNING' THEN 0.4 ELSE 0.0 END * greatest(0.5, 1 - 0.1 * (hop - 1)), 2) AS hours FROM ({levels}) l JOIN n USING (node)) {tail}"""


def _changes(spark) -> DataFrame:
    return impact.changes(spark, [("nation::3", "amount", "rename"), ("nation::4", None, "drop"), ("region::1", "amount", "type_change"), ("nowhere", "amount", "drop"), ("nation::3", "zzz", "add")])


@query(_blast_sql("SELECT change_id, node, system, node_type, severity, CAST(hop AS INTEGER) AS hop, array_to_string(path, ' > ') AS path, reason, CAST(hours AS DOUBLE) AS hours FROM imp"))
def blast_radius(spark, sf_dir):
    return impact.simulate(*provenance(spark, sf_dir), _changes(spark)).selectExpr("change_id", "node", "system", "node_type", "severity", "hop_distance AS hop", "array_join(path_from_source, ' > ') AS path", "reason", "CAST(fix_hours AS DOUBLE) AS hours")


_TOTALS = """SELECT change_id, root AS changed_node, coalesce(col, '') AS changed_column, kind AS change_type, coalesce(t, 0) AS total_impacted, coalesce(br, 0) AS breaking_count, coalesce(w, 0) AS warning_count, coalesce(o, 0) AS ok_count, coalesce(CAST(h AS DOUBLE), 0) AS total_fix_hours
FROM ch LEFT JOIN (SELECT change_id, count(*) AS t, count(*) FILTER (severity = 'BREAKING') AS br, count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity = 'OK') AS o, sum(CAST(hours AS DECIMAL(18, 2))) AS h FROM imp GROUP BY change_id) USING (change_id)"""


@query(_blast_sql(_TOTALS))
def blast_totals(spark, sf_dir):
    c = _changes(spark)
    return impact.totals(c, impact.simulate(*provenance(spark, sf_dir), c)).withColumns({"changed_column": F.coalesce("changed_column", F.lit("")), "total_fix_hours": F.col("total_fix_hours").cast("double")})


@query(_blast_sql("SELECT change_id, system, count(*) FILTER (severity = 'BREAKING') AS breaking, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'OK') AS ok FROM imp GROUP BY ALL"))
def blast_by_system(spark, sf_dir):
    found = impact.by_system(impact.simulate(*provenance(spark, sf_dir), _changes(spark)))
    return found.select("change_id", "system", F.col("BREAKING").alias("breaking"), F.col("WARNING").alias("warning"), F.col("OK").alias("ok"))


@query(_blast_sql(f"""SELECT change_id, '=== Blast Radius Report ===' || chr(10) || 'Changed node  : ' || changed_node || chr(10) || 'Changed column: ' || coalesce(nullif(changed_column, ''), 'N/A') || chr(10) || 'Change type   : ' || change_type || chr(10) || chr(10) ||
 'Total impacted: ' || total_impacted || chr(10) || '  BREAKING    : ' || breaking_count || chr(10) || '  WARNING     : ' || warning_count || chr(10) || '  OK          : ' || ok_count || chr(10) || chr(10) || 'Estimated fix : ' || format('{{:.1f}}', CAST(total_fix_hours AS DOUBLE)) || ' hrs' || chr(10) || chr(10) || 'By system:' || coalesce(s, '') AS summary
 FROM ({_TOTALS}) t LEFT JOIN (SELECT change_id, string_agg(chr(10) || '  ' || rpad(system, 12, ' ') || '  BREAKING=' || br || '  WARNING=' || w, '' ORDER BY system) AS s FROM (SELECT change_id, system, count(*) FILTER (severity = 'BREAKING') AS br, count(*) FILTER (severity = 'WARNING') AS w FROM imp GROUP BY ALL) x GROUP BY change_id) y USING (change_id)"""))
def blast_summary(spark, sf_dir):
    c = _changes(spark)
    return impact.summary(c, impact.simulate(*provenance(spark, sf_dir), c))


@query(_blast_sql(f"SELECT change_id, changed_node, total_impacted, total_fix_hours, total_impacted AS listed FROM ({_TOTALS}) t"))
def blast_json(spark, sf_dir):
    c = _changes(spark)
    lines = impact.as_json(c, impact.simulate(*provenance(spark, sf_dir), c))
    said = lambda k: F.max(F.get_json_object("json", f"$.{k}"))
    listed = F.sum(F.coalesce(F.json_array_length(F.get_json_object("json", "$.impacted_nodes")), F.lit(0)))
    return lines.groupBy("change_id").agg(
        said("changed_node").alias("changed_node"), said("total_impacted").cast("bigint").alias("total_impacted"), said("total_fix_hours").cast("double").alias("total_fix_hours"), listed.cast("bigint").alias("listed"),
    )


@query(_blast_sql("SELECT substr(node, 1, 40) AS node, upper(system) AS system, severity, CAST(hop AS INTEGER) AS hop, substr(reason, 1, 60) AS reason, format('{:.1f}', CAST(hours AS DOUBLE)) AS hours FROM imp WHERE change_id = '1'"))
def impact_grid(spark, sf_dir):
    return report.impact_grid(impact.simulate(*provenance(spark, sf_dir), _changes(spark).where("change_id = '1'")))


@query(f"""{_FK}, d AS (SELECT src, count(*) AS k FROM e GROUP BY src) SELECT node, system, coalesce(d.k, 0) AS out_degree, round_even(coalesce(d.k, 0)::DOUBLE / ((SELECT count(*) FROM n) - 1), 4) AS score
FROM n LEFT JOIN d ON d.src = node ORDER BY score DESC, lvl, n.k LIMIT 10""")
def top_risk(spark, sf_dir):
    return impact.top_risk(*provenance(spark, sf_dir)).select("node", "system", "out_degree", "score")


# --- reports and persistence ---------------------------------------------------------------------------------------


@query(f"""SELECT line FROM (VALUES ('flowchart LR'), (''), (''), ('{report.SOURCE_STYLE}'), ('{report.DERIVED_STYLE}')) t(line)
UNION ALL SELECT '    ' || translate(node, '.- ', '___') || CASE WHEN lvl = 0 THEN '["' || node || '"]' ELSE '("' || node || '")' END FROM ({NODES}) n
UNION ALL SELECT '    ' || translate(src, '.- ', '___') || ' -->' || CASE WHEN lvl = 1 THEN '' ELSE '|' || system || '|' END || ' ' || translate(dst, '.- ', '___') FROM ({EDGES}) e
UNION ALL SELECT '    class ' || translate(node, '.- ', '___') || CASE WHEN lvl = 0 THEN ' source' ELSE ' derived' END FROM ({NODES}) n""")
def mermaid_lines(spark, sf_dir):
    return report.mermaid_lines(*provenance(spark, sf_dir)).select("line")


@query(f"SELECT system AS name, count(*) AS n FROM ({NODES}) x GROUP BY system UNION ALL SELECT 'cross', count(*) FROM ({EDGES}) e WHERE system = 'cross'")
def stats_chips(spark, sf_dir):
    return report.stats_chips(*provenance(spark, sf_dir))


@query(f"SELECT substr(node, 1, 40) AS id, substr(node, 1, 40) AS label, upper(system) AS system, node_type AS type FROM ({NODES}) x")
def node_grid(spark, sf_dir):
    return report.node_grid(provenance(spark, sf_dir)[0])


@query(f"SELECT substr(src, 1, 40) AS source, substr(dst, 1, 40) AS target, upper(system) AS system, CASE WHEN lvl = 1 THEN '' ELSE system END AS type FROM ({EDGES}) x")
def edge_grid(spark, sf_dir):
    return report.edge_grid(provenance(spark, sf_dir)[1])


@query(f"SELECT src AS source, dst AS target, m[1] AS target_col, m[2] AS source_expression FROM (SELECT src, dst, unnest({_DECODE}) AS m FROM ({EDGES}) e) x")
def mapping_grid(spark, sf_dir):
    return report.mapping_grid(provenance(spark, sf_dir)[1])


@query(f"SELECT node FROM ({NODES}) x ORDER BY contains(lower(node), 'source') DESC, lvl, k LIMIT 1")
def default_target(spark, sf_dir):
    return report.default_target(provenance(spark, sf_dir)[0])


@query(f"SELECT node, CASE WHEN lvl = 1 THEN 'new' ELSE 'old' END AS version FROM ({NODES}) x")
def upsert_nodes(spark, sf_dir):
    n = provenance(spark, sf_dir)[0].selectExpr("node", "'old' AS version", "seq")
    new = n.where("seq[0] = 1").withColumn("version", F.lit("new"))
    return store.upserted_nodes(n, new).select("node", "version")


@query(f"SELECT src, dst, CASE WHEN lvl = 2 THEN 'new' ELSE system END AS version FROM ({EDGES}) x")
def upsert_edges(spark, sf_dir):
    e = provenance(spark, sf_dir)[1].selectExpr("src", "dst", "system AS version", "seq")
    return store.upserted_edges(e, e.where("seq[0] = 2").withColumn("version", F.lit("new"))).select("src", "dst", "version")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    materialise(spark.range(1))  # sets the folder where the session hasn't
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(f"""SELECT 'node' AS kind, node AS a, CAST(is_source AS VARCHAR) AS b FROM ({SQL["sql_graph_nodes"]}) n UNION ALL SELECT 'edge', src, dst FROM ({SQL["sql_graph_edges"]}) e
UNION ALL SELECT 'health', 'true', 'true'""")
def store_round_trip(spark, sf_dir):
    """An empty store, filled by upserts, read again."""
    nodes, edges = graph.graph_of(_kept_records(spark, sf_dir), "-")
    kept = store.Store(spark, _folder(spark, "store"))
    before = kept.health()
    kept.create()
    kept.upsert_nodes(nodes)
    kept.upsert_edges(edges)
    health = spark.sql("SELECT 'health' AS kind, :a AS a, :b AS b", args={"a": str(not before).lower(), "b": str(kept.health()).lower()})
    return kept.load_nodes().selectExpr("'node' AS kind", "node AS a", "CAST(is_source AS STRING) AS b").unionByName(kept.load_edges().selectExpr("'edge' AS kind", "src AS a", "dst AS b")).unionByName(health)


@query("""WITH r AS (SELECT 'r' || r_regionkey AS t FROM region), n AS (SELECT 'n' || n_nationkey AS t, 'r' || n_regionkey AS up FROM nation)
SELECT 'table' AS answer, t AS value FROM (SELECT 'world' AS t UNION ALL SELECT t FROM r UNION ALL SELECT t FROM n) x
UNION ALL SELECT 'upstream', up FROM n WHERE t = 'n3' UNION ALL SELECT 'upstream', 'world' UNION ALL SELECT 'downstream', t FROM n WHERE up = 'r1'
UNION ALL SELECT 'impact', 'world > ' || t FROM r UNION ALL SELECT 'impact', 'world > ' || up || ' > ' || t FROM n
UNION ALL SELECT 'parsed', CAST(count(*) AS VARCHAR) FROM (SELECT t FROM r UNION ALL SELECT t FROM n) x UNION ALL SELECT 'unknown', 'nowhere'""")
def service_answers(spark, sf_dir):
    """A service that is told one text with a statement for each region and nation."""
    rows = _views(spark, sf_dir, "SELECT 'INSERT INTO r' || r_regionkey || ' SELECT a FROM world' AS s FROM region UNION ALL SELECT 'INSERT INTO n' || n_nationkey || ' SELECT a FROM r' || n_regionkey FROM nation").collect()
    said = service.Service(spark)
    parsed = said.parse(";\n".join(r["s"] for r in rows))
    answers = [("parsed", str(parsed["parsed_statements"]))]
    try:
        said.lineage("nowhere")
    except service.UnknownTable as e:
        answers.append(("unknown", e.args[0]))
    lineage = said.lineage("n3")["upstream"].selectExpr("'upstream' AS answer", "node AS value")
    out = said.tables().selectExpr("'table' AS answer", "node AS value").unionByName(lineage).unionByName(said.downstream("r1").selectExpr("'downstream' AS answer", "node AS value"))
    out = out.unionByName(said.impact("world").selectExpr("'impact' AS answer", "array_join(path, ' > ') AS value"))
    return out.unionByName(spark.createDataFrame(answers, "answer string, value string"))


# --- the five steps of a retail pipeline, run on the tables -----------------------------------------------------------
# Both dialects read these: extraction, customers, enrichment, daily sales, rolling mart.

_RETAIL = {
    "retail_01": """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus, o_totalprice FROM orders
WHERE o_orderdate >= DATE '1995-01-01' AND o_orderstatus NOT IN ('X', 'Z')""",
    "retail_02": """SELECT c_custkey, lower(trim(c_name)) || '@example.com' AS email, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment,
CASE WHEN c_acctbal >= 5000 THEN 'PREMIUM' WHEN c_acctbal >= 0 THEN 'STANDARD' ELSE 'DEBT' END AS tier, c_acctbal > 0 AS is_active FROM customer
WHERE c_nationkey IS NOT NULL""",
    "retail_03": """SELECT l_orderkey, l_linenumber, p_brand, l_quantity, l_extendedprice - l_quantity * p_retailprice AS gross_margin FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_returnflag <> 'R'""",
    "retail_04": """SELECT CAST(o_orderdate AS DATE) AS order_date, n_name, c_mktsegment, count(DISTINCT o_orderkey) AS total_orders, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS total_quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
GROUP BY CAST(o_orderdate AS DATE), n_name, c_mktsegment""",
    "retail_05": """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS order_date, c_mktsegment, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS revenue FROM orders JOIN customer ON c_custkey = o_custkey
GROUP BY CAST(o_orderdate AS DATE), c_mktsegment),
w AS (SELECT d.*, sum(revenue) OVER (PARTITION BY c_mktsegment ORDER BY order_date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS revenue_90d FROM d)
SELECT CAST(order_date AS VARCHAR(10)) AS order_date, c_mktsegment, CAST(revenue_90d AS DOUBLE) AS revenue_90d, CASE WHEN revenue_90d >= 5000000 THEN 'PLATINUM' WHEN revenue_90d >= 1000000 THEN 'GOLD' ELSE 'BRONZE' END AS tier FROM w""",
}


def _retail(name: str) -> None:
    text = _RETAIL[name]
    if name in ("retail_01", "retail_04"):
        text = text.replace("CAST(o_orderdate AS DATE) AS order_date", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS order_date")
    text = text.replace("sum(CAST(l_quantity AS DECIMAL(18, 2))) AS", "CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS")
    Q[name] = lambda spark, sf_dir: _views(spark, sf_dir, text.replace("VARCHAR(10)", "STRING"))
    SQL[name] = text.replace("VARCHAR(10)", "VARCHAR")


for _name in _RETAIL:
    _retail(_name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks, and how long it takes to mend, for several changes at once."""
    return Q["blast_radius"](spark, sf_dir)
