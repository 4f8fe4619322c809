"""dbt models, PySpark scripts and their files."""

import time

import pytest

from headwater.operators.dbt_extract import all_upstream, dependencies, parse_dbt_models
from headwater.operators.script_extract import parse_script, parse_scripts, parse_spark_code
from headwater.sources import files


def model(spark, sql, name="m", **k):
    return all_upstream(parse_dbt_models(spark.createDataFrame([(name, sql)], "model_name string, sql string"), **k)).first()


@pytest.mark.parametrize(
    ("sql", "refs", "sources"),
    [
        ("SELECT * FROM {{ ref('stg_orders') }}", ["stg_orders"], []),
        ("SELECT * FROM {{ref(\"a\")}} JOIN {{ REF( 'b' ) }} JOIN {{ ref('a') }}", ["a", "b", "a"], []),
        ("SELECT * FROM {{ source('raw', 'orders') }} JOIN {{ source(\"crm\",\"c\") }}", [], [("raw", "orders"), ("crm", "c")]),
        ("SELECT 1 AS x", [], []),
        ("SELECT * FROM {{ ref('pkg', 'two') }}", [], []),
    ],
)
def test_dbt_dependencies(spark, sql, refs, sources):
    r = model(spark, sql)
    assert r.ref_deps == refs and [tuple(s) for s in r.source_deps] == sources and r.all_upstream == refs + [".".join(s) for s in sources]


def test_dbt_names_and_materialization(spark):
    assert model(spark, "SELECT 1").warehouse_table == "analytics.public.m"
    assert model(spark, "SELECT 1", database="prod", schema="rep").warehouse_table == "prod.rep.m"
    assert model(spark, "{{ config(\n materialized='incremental') }} SELECT 1").materialization == "incremental"
    assert model(spark, "SELECT 1").materialization == "view"


def test_dbt_columns(spark):
    sql = "WITH a AS (SELECT z FROM q)\nSELECT\n t.customer_id, ROUND(price * qty, 2) AS amount, t.*, {{ x }} AS p\nFROM {{ ref('r') }} {% if a %} t {% endif %}"
    assert [tuple(c) for c in model(spark, sql).column_lineage] == [("customer_id", "t.customer_id"), ("amount", "ROUND(price * qty, 2)"), ("*", "t.*"), ("p", "placeholder")]
    assert model(spark, "SELECT * FROM {{ ref('a') }}").column_lineage == [] and model(spark, "{{ config() }}").column_lineage == []


def test_dbt_columns_over_several_lines_and_odd_text(spark):
    cols = lambda sql: [tuple(c) for c in model(spark, sql).column_lineage]
    assert cols("SELECT CASE WHEN a\n THEN 1\n END\n AS kind, f(g(a, b),\n c) x, 1 AS 2b FROM t") == [("kind", "CASE WHEN a\n THEN 1\n END"), ("f(g(a, b),\n c) x", "f(g(a, b),\n c) x"), ("2b", "1")]
    assert cols("SELECT a FROM t UNION SELECT b AS c FROM {{ source('s', 't') }}") == [("c", "b")]
    assert cols("SELECT {{ ref('m') }}.a AS x, {{ source('s', 't') }}.b FROM {{ ref('m') }}") == [("x", "m.a"), ("b", "s__t.b")]
    assert cols("SELECT a, (b FROM t") == [("a", "a"), ("(b", "(b")] and cols("SELECT a") == [] and cols("") == []
    assert model(spark, None).ref_deps == [] and model(spark, None).column_lineage == []
    r = model(spark, "{{ config(tags=['x'], Materialized = \"table\") }}{{ config(materialized='view2') }} {{- ref('a') -}} {{ ref(a) }} {{ source('a') }} {{ ref('') }}")
    assert r.materialization == "table" and r.ref_deps == [] and r.source_deps == []


def test_dbt_takes_time_in_proportion(spark):
    sql = "SELECT " + ", ".join(f"f(a{i}, b) AS c{i}" for i in range(16_000)) + " FROM {{ ref('x') }}"
    model(spark, "SELECT 1 AS a FROM t")
    t = time.perf_counter()
    found = model(spark, sql).column_lineage
    assert len(found) == 16_000 and tuple(found[-1]) == ("c15999", "f(a15999, b)") and time.perf_counter() - t < 20


def test_of_a_repeated_model_name_the_last_counts(spark):
    rows = [("a", "SELECT 1 FROM {{ ref('zz') }}", 1), ("a", "SELECT 1 FROM {{ ref('first') }}", 3), ("b", "SELECT 1", 2), ("a", "SELECT 2 FROM {{ ref('mid') }}", 2)]
    df = spark.createDataFrame(rows, "model_name string, sql string, ord int")
    assert {r.model_name: r.ref_deps for r in dependencies(parse_dbt_models(df), "ord").collect()} == {"a": ["first"], "b": []}
    as_read = parse_dbt_models(df.coalesce(1).drop("ord"))
    assert {r.model_name: r.ref_deps for r in dependencies(as_read).collect()} == {"a": ["mid"], "b": []}


@pytest.mark.parametrize(
    ("call", "path"),
    [
        ("csv(base, 'id INT')", "<unknown_csv>"), ("csv('p', 'id INT')", "p"), ("csv(schema='id INT', path='p')", "p"), ("csv(base, path='p')", "p"), ("csv()", "<unknown_csv>"),
        ("parquet(*paths)", "<unknown_parquet>"), ("load(base, 'csv')", "<unknown_unknown>"), ("json(path=base)", "<unknown_json>"), ("table(tableName='t')", "t"),
    ],
)
def test_only_the_first_argument_is_a_path(call, path):
    assert parse_script(f"a = spark.read.{call}")["sources"][0]["path"] == path


def test_writes_do_not_take_a_mode_for_a_path():
    r = parse_script("a = spark.read.parquet('x')\na.write.parquet(out, 'overwrite')\na.write.csv('y', mode='append')\na.write.saveAsTable(name='t', mode='append')\n")
    assert [s["path"] for s in r["sinks"]] == ["<unknown_parquet>", "y", "t"]


def test_dbt_dependency_graph(spark):
    df = parse_dbt_models(spark.createDataFrame([("a", "SELECT 1"), ("b", "SELECT * FROM {{ ref('a') }}")], "model_name string, sql string"))
    assert {r.model_name: r.ref_deps for r in dependencies(df).collect()} == {"a": [], "b": ["a"]}


def test_project_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("SELECT 1")
    (tmp_path / "sub" / "b.sql").write_text("SELECT * FROM {{ ref('a') }}")
    (tmp_path / "sub" / "schema.yml").write_text("models:\n  - name: b\n    description: 'Second'\n    tags: [x, 'y']\n    columns:\n      - name: id\n        description: key\n")
    got = {r.model_name: (r.description, r.tags) for r in parse_dbt_models(files.dbt_project(spark, str(tmp_path))).collect()}
    assert got == {"a": ("", []), "b": ("Second", ["x", "y"])}
    assert files.dbt_project(spark, str(tmp_path / "none")).count() == 0
    assert {r.pipeline_name for r in files.sql_directory(spark, str(tmp_path)).collect()} == {"a"}


SCRIPT = """
    orders = spark.read.parquet("s3://raw/orders/")
    events = spark.read.json(path="s3://raw/events/")
    clean = orders.filter("x > 1").select("id", "amount")
    events_clean = events.where(col("a") > 1)
    both = clean.join(events_clean, on="id", how="left")
    out = both.groupBy("id", "day").agg(sum("amount"))
    out.write.mode("overwrite").parquet("s3://out/a/")
    events_clean.write.csv("s3://out/b/")
"""


def test_script(spark):
    r = parse_spark_code(spark, SCRIPT, "etl").first()
    assert [(s.path, s.format, s.dataset_type) for s in r.sources] == [("s3://raw/orders/", "parquet", "source"), ("s3://raw/events/", "json", "source")]
    assert [(s.path, s.format) for s in r.sinks] == [("s3://out/a/", "parquet"), ("s3://out/b/", "csv")]
    assert [(t.operation, t.input_vars, t.output_var) for t in r.transformations] == [
        ("select", ["orders"], "clean"), ("filter", ["orders"], None), ("filter", ["events"], "events_clean"), ("join", ["clean", "events_clean"], "both"), ("agg", ["both"], "out"), ("groupBy", ["both"], None),
    ]
    assert r.transformations[3].details.how == "left" and r.transformations[5].details.group_by == ["id", "day"] and r.intermediate_vars == ["both", "clean"]


@pytest.mark.parametrize(
    ("code", "source"),
    [
        ("x = spark.table('db.t')", ("db.t", "table")), ("x = spark.read.table('db.t')", ("db.t", "table")), ("x = spark.read.load('p', format='orc')", ("p", "orc")), ("x = spark.read.load('p')", ("p", "unknown")),
        ("x = spark.read.format('avro').load('p')", ("p", "avro")), ("x = spark.read.csv(path_var)", ("<unknown_csv>", "csv")), ("x = spark.read.parquet('p').filter('a')", ("p", "parquet")),
    ],
)
def test_reads(code, source):
    assert [(s["path"], s["format"]) for s in parse_script(code)["sources"]] == [source]


def test_writes_unions_and_columns():
    r = parse_script("a = spark.table('t')\nb = a.withColumn('n', lit(1)).drop('x').distinct()\nc = b.unionByName(a)\nc.write.saveAsTable('m.t')\nc.write.save('p', format='orc')\nc.writeTo('z')")
    assert [(s["path"], s["format"]) for s in r["sinks"]] == [("m.t", "table"), ("p", "orc")]
    assert [t["operation"] for t in r["transformations"]] == ["distinct", "drop", "withColumn", "union"]
    assert r["transformations"][2]["details"]["column"] == "n" and r["transformations"][3]["input_vars"] == ["b", "a"]


def test_script_errors_and_files(spark, tmp_path):
    with pytest.raises(SyntaxError):
        parse_spark_code(spark, "def (")
    rows = spark.createDataFrame([("bad", "def ("), ("none", None), ("ok", "x = 1")], "pipeline_name string, code string")
    got = {r.pipeline_name: (r.error is None, r.sources, r.sinks) for r in parse_scripts(rows).collect()}
    assert got == {"bad": (False, [], []), "none": (True, [], []), "ok": (True, [], [])}
    (tmp_path / "job.py").write_text("x = spark.table('t')")
    assert parse_scripts(files.script_files(spark, str(tmp_path))).first().pipeline_name == "job"
    with pytest.raises(FileNotFoundError):
        files.script_files(spark, str(tmp_path / "none"))
