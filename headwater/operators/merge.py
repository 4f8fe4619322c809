"""One graph of all systems.

nodes: node, label, system, node_type, metadata map<string,string>, seq
edges: src, dst, system, transformation_type, column_mappings, pipeline_name, shared_path, seq
paths: path_key, node, system, seq
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.plans.closure import simple_paths

from .graph import MAPPINGS, upsert_edges, upsert_nodes

NODE_SCHEMA = "node string, label string, system string, node_type string, metadata map<string,string>, seq array<bigint>"
EDGE_SCHEMA = f"src string, dst string, system string, transformation_type string, column_mappings {MAPPINGS}, pipeline_name string, shared_path string, seq array<bigint>"
PATH_SCHEMA = "path_key string, node string, system string, seq array<bigint>"
#: Order of the systems along a pipeline; cross edges lead forward.
SYSTEMS = ("airflow", "sql", "spark", "dbt")


def path_key(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, "/+$", ""))


@dataclass(frozen=True)
class Unified:
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "Unified":
        return Unified(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), spark.createDataFrame([], PATH_SCHEMA))

    def merged(self, nodes: DataFrame, edges: DataFrame, paths: DataFrame | None = None) -> "Unified":
        """First writer of a node wins, last attributes of an edge do."""
        p = self.paths if paths is None else _paths(self.paths, paths)
        return Unified(upsert_nodes(self.nodes, nodes), upsert_edges(self.edges, edges), p)


def _paths(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.where("path_key <> ''") for p in parts]).groupBy("path_key", "node", "system").agg(F.min("seq").alias("seq"))


def together(*parts: Unified) -> Unified:
    """One graph of the graphs of different systems, each of which went into an empty one. Their places begin with the
    system, so it is the same as entering one after the other, but rows are shuffled once and not once for each system."""
    return Unified(upsert_nodes(*(p.nodes for p in parts)), upsert_edges(*(p.edges for p in parts)), _paths(*(p.paths for p in parts)))


def _nodes(df: DataFrame, node, label, system: str, node_type, seq, **metadata) -> DataFrame:
    entries = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    meta = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()) if entries else F.create_map().cast("map<string,string>")
    kind = node_type if isinstance(node_type, Column) else F.lit(node_type)
    return df.select(node.alias("node"), label.alias("label"), F.lit(system).alias("system"), kind.alias("node_type"), meta.cast("map<string,string>").alias("metadata"), seq.alias("seq"))


def _edges(df: DataFrame, src, dst, system, kind, seq, mappings=None, pipeline=None, shared=None) -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return df.select(
        src.alias("src"), dst.alias("dst"), col(system).alias("system"), col(kind).alias("transformation_type"),
        (F.array() if mappings is None else mappings).cast(MAPPINGS).alias("column_mappings"), text(pipeline).alias("pipeline_name"), text(shared).alias("shared_path"), seq.alias("seq"),
    )


def _seq(*parts) -> Column:
    return F.array(*(p.cast("bigint") if isinstance(p, Column) else F.lit(p).cast("bigint") for p in parts))


def add_sql(u: Unified, nodes: DataFrame, edges: DataFrame, register: bool = False) -> Unified:
    """The SQL graph. ``register``: also enter table names as paths, so that they can link across systems."""
    seq = F.concat(_seq(0), F.col("seq"))
    n = _nodes(nodes, F.col("node"), F.col("node"), "sql", F.when(F.col("is_source"), "SourceTable").otherwise("SinkTable"), seq, schema=F.col("schema"), row_count_estimate=F.col("row_count_estimate"), last_updated=F.col("last_updated"), is_source=F.col("is_source"))
    e = _edges(edges, F.col("src"), F.col("dst"), "sql", F.coalesce("transformation_type", F.lit("")), seq, F.col("column_mappings"), F.col("pipeline_name"))
    paths = nodes.select(path_key(F.col("node")).alias("path_key"), "node", F.lit("sql").alias("system"), seq.alias("seq")) if register else None
    return u.merged(n, e, paths)


def add_spark(u: Unified, scripts: DataFrame, namespaced: bool = False) -> Unified:
    """Datasets, source-to-sink edges and join edges of script records with a column ``ord`` that orders them.
    ``namespaced``: variables carry the pipeline's name, so that equal names of two scripts stay apart."""
    var = (lambda v: F.concat(F.lit("spark::"), F.col("pipeline_name"), F.lit("::"), v)) if namespaced else (lambda v: F.concat(F.lit("spark::"), v))
    data = F.concat(F.transform("sources", lambda d, i: F.struct(d.alias("d"), i.alias("i"))), F.transform("sinks", lambda d, i: F.struct(d.alias("d"), (i + 100000).alias("i"))))
    one = scripts.select("pipeline_name", "ord", F.inline(data))
    path = F.col("d.path")
    n = _nodes(one, F.concat(F.lit("spark::"), path), path, "spark", "SparkDataset", _seq(1, F.col("ord"), F.col("i")), format=F.col("d.format"), dataset_type=F.col("d.dataset_type"), pipeline=F.col("pipeline_name"))
    paths = one.select(path_key(path).alias("path_key"), F.concat(F.lit("spark::"), path).alias("node"), F.lit("spark").alias("system"), _seq(1, F.col("ord"), F.col("i")).alias("seq"))
    # sources times sinks of one script, expanded within its row
    both = scripts.select("pipeline_name", "ord", "sinks", F.posexplode("sources").alias("i", "a")).select("pipeline_name", "ord", "i", "a", F.posexplode("sinks").alias("j", "b"))
    e1 = _edges(both, F.concat(F.lit("spark::"), F.col("a.path")), F.concat(F.lit("spark::"), F.col("b.path")), "spark", "spark_pipeline", _seq(1, F.col("ord"), 0, F.col("i"), F.col("j")), pipeline=F.col("pipeline_name"))
    joins = scripts.select("pipeline_name", "ord", F.posexplode("transformations").alias("k", "t")).where("t.operation = 'join' and size(t.input_vars) >= 2")
    ends = joins.select("pipeline_name", "ord", "k", F.col("t.output_var").alias("out"), F.posexplode(F.slice("t.input_vars", 1, 2)).alias("i", "v"))
    place = lambda last: _seq(1, F.col("ord"), 200000, F.col("k"), F.col("i"), last)
    n2 = _nodes(ends, var(F.col("v")), F.col("v"), "spark", "SparkDataset", place(0)).unionByName(_nodes(ends.where("out is not null"), var(F.col("out")), F.col("out"), "spark", "SparkDataset", place(1)))
    e2 = _edges(ends.where("out is not null"), var(F.col("v")), var(F.col("out")), "spark", "join", place(0))
    return u.merged(n.unionByName(n2), e1.unionByName(e2), paths)


def add_dbt(u: Unified, models: DataFrame) -> Unified:
    """Models, references (with stubs for unknown ones) and sources of model records with a column ``ord``."""
    own = F.concat(F.lit("dbt::"), F.col("model_name"))
    n = _nodes(models, own, F.col("model_name"), "dbt", "DbtModel", _seq(2, 0, F.col("ord")), warehouse_table=F.col("warehouse_table"), materialization=F.col("materialization"), description=F.col("description"), tags=F.to_json("tags"), raw_sql=F.col("raw_sql"))
    ref = models.select("model_name", "ord", "column_lineage", F.posexplode("ref_deps").alias("i", "r"))
    stub = F.concat(F.lit("dbt::"), F.col("r"))
    n_ref = _nodes(ref, stub, F.col("r"), "dbt", "DbtModel", _seq(2, 1, F.col("ord"), F.col("i")))
    e_ref = _edges(ref, stub, own, "dbt", "ref", _seq(2, 1, F.col("ord"), 0, F.col("i")), F.col("column_lineage"))
    src = models.select("model_name", "ord", F.posexplode("source_deps").alias("i", "s"))
    full = F.concat_ws(".", "s.source_name", "s.table_name")
    sid = F.concat(F.lit("dbt::source::"), full)
    n_src = _nodes(src, sid, full, "dbt", "SourceTable", _seq(2, 1, F.col("ord"), 100000 + F.col("i")), source_name=F.col("s.source_name"), table_name=F.col("s.table_name"))
    e_src = _edges(src, sid, own, "dbt", "source", _seq(2, 1, F.col("ord"), 1, F.col("i")))
    paths = (
        models.select(F.posexplode(F.array("warehouse_table", "model_name")).alias("i", "p"), own.alias("node"), "ord")
        .select(path_key(F.col("p")).alias("path_key"), "node", F.lit("dbt").alias("system"), _seq(2, 0, F.col("ord"), F.col("i")).alias("seq"))
        .unionByName(src.select(path_key(full).alias("path_key"), sid.alias("node"), F.lit("dbt").alias("system"), _seq(2, 1, F.col("ord"), F.col("i")).alias("seq")))
    )
    return u.merged(n.unionByName(n_ref).unionByName(n_src), e_ref.unionByName(e_src), paths)


def add_airflow(u: Unified, tasks: DataFrame) -> Unified:
    """Tasks, their dependencies within a DAG and the paths they touch, from descriptors with a column ``ord``."""
    own = F.concat(F.lit("airflow::"), F.col("node_id"))
    n = _nodes(tasks, own, F.concat_ws("/", "dag_id", "task_id"), "airflow", "AirflowTask", _seq(3, F.col("ord")), dag_id=F.col("dag_id"), task_id=F.col("task_id"), operator=F.col("operator"), input_paths=F.to_json("input_paths"), output_paths=F.to_json("output_paths"))
    up = tasks.select("node_id", "ord", "dag_id", F.posexplode("upstream_task_ids").alias("i", "t")).withColumn("up_id", F.concat_ws(".", "dag_id", "t"))
    known = tasks.select(F.col("node_id").alias("up_id")).distinct()
    e = _edges(up.join(known, "up_id"), F.concat(F.lit("airflow::"), F.col("up_id")), own, "airflow", "dag_dependency", _seq(3, F.col("ord"), F.col("i")))
    touched = tasks.select(own.alias("node"), "ord", F.posexplode(F.concat("input_paths", "output_paths")).alias("i", "p"))
    paths = touched.select(path_key(F.col("p")).alias("path_key"), "node", F.lit("airflow").alias("system"), _seq(3, F.col("ord"), F.col("i")).alias("seq"))
    return u.merged(n, e, paths)


def cross_edges(u: Unified) -> DataFrame:
    """Edges between nodes of different systems that share a path and aren't joined yet: an equi-join on the path with
    the systems' order as condition. Of several shared paths the first counts. Only paths that two systems share enter
    the join, so a path that many nodes of one system share costs nothing."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SYSTEMS)), F.col("system"))
    ranked = u.paths.withColumn("r", rank).where("r > 0")
    shared = ranked.groupBy("path_key").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("path_key")
    p = ranked.join(shared, "path_key", "left_semi")
    b = p.select(F.col("path_key").alias("key_b"), F.col("node").alias("dst"), F.col("system").alias("sys_b"), F.col("r").alias("rb"), F.col("seq").alias("seq_b"))
    pairs = p.join(b, (F.col("path_key") == F.col("key_b")) & (F.col("r") < F.col("rb"))).select("path_key", F.col("node").alias("src"), "dst", "system", "sys_b", F.concat(F.array(F.lit(4).cast("bigint")), "seq", "seq_b").alias("seq"))
    new = pairs.join(u.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    one = new.groupBy("src", "dst").agg(F.min_by(F.struct("path_key", "system", "sys_b"), "seq").alias("x"), F.min("seq").alias("seq"))
    return _edges(one, F.col("src"), F.col("dst"), "cross", F.concat(F.col("x.system"), F.lit("_to_"), F.col("x.sys_b")), F.col("seq"), shared=F.col("x.path_key"))


def with_cross_edges(u: Unified) -> Unified:
    """Cross edges join what no edge joins, so none of them meets another."""
    return Unified(u.nodes, u.edges.unionByName(cross_edges(u)), u.paths)


def nodes_by_system(u: Unified, system: str) -> DataFrame:
    return u.nodes.where(F.col("system") == system)


def coverage(nodes: DataFrame) -> DataFrame:
    """(system, n)."""
    return nodes.groupBy(F.coalesce("system", F.lit("unknown")).alias("system")).agg(F.count("*").alias("n"))


def subgraph(u: Unified, system: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a system and the edges between them."""
    n = nodes_by_system(u, system)
    ids = n.select("node")
    e = u.edges.join(ids, F.col("src") == F.col("node"), "left_semi").join(ids, F.col("dst") == F.col("node"), "left_semi")
    return n, e


def comparison(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(system, nodes, edges, types): figures of each system side by side; types as "type: n", sorted."""
    systems = nodes.sparkSession.createDataFrame([(s,) for s in SYSTEMS], "system string")
    kinds = nodes.groupBy("system", "node_type").agg(F.count("*").alias("k"))
    n = kinds.groupBy("system").agg(F.sum("k").alias("nodes"), F.array_join(F.sort_array(F.collect_list(F.format_string("%s: %d", "node_type", "k"))), ", ").alias("types"))
    e = edges.groupBy("system").agg(F.count("*").alias("edges"))
    return systems.join(n, "system", "left").join(e, "system", "left").select("system", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("types", F.lit("")).alias("types"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_tables, cross_edges)."""
    n = nodes.agg(F.count_if(F.col("node_type") == "SourceTable").alias("source_tables"))
    return n.crossJoin(edges.agg(F.count_if(F.col("system") == "cross").alias("cross_edges")))  # one row each


def end_to_end_paths(u: Unified, src: str, dst: str, max_hops: int | None = None) -> DataFrame:
    return simple_paths(u.edges, src, dst, max_hops)
