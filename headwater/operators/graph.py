"""The lineage graph as two relations, and the questions asked of it.

nodes: node, schema, row_count_estimate, last_updated, is_source, seq
edges: src, dst, column_mappings, transformation_type, pipeline_name, seq

``seq`` is an array of integers that come from the data (text, statement, position), so orders are repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.plans.closure import first_by, reach, simple_paths, topological_levels
from headwater.plans.stages import keyed, kept, parts

MAPPINGS = "array<struct<target_col:string,source_expression:string>>"
NODE_SCHEMA = "node string, schema string, row_count_estimate bigint, last_updated string, is_source boolean, seq array<bigint>"
EDGE_SCHEMA = f"src string, dst string, column_mappings {MAPPINGS}, transformation_type string, pipeline_name string, seq array<bigint>"


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)


def upsert_nodes(*parts: DataFrame) -> DataFrame:
    """Union in which the first writer of a node wins."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_by(out, ["node"], "seq")


def upsert_edges(*parts: DataFrame) -> DataFrame:
    """Union with one edge for each pair: the last attributes, the first place."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    attributes = [c for c in out.columns if c not in ("src", "dst", "seq")]
    last = F.max_by(F.struct(*attributes), "seq").alias("a")
    return out.groupBy("src", "dst").agg(last, F.min("seq").alias("seq")).select("src", "dst", *(F.col(f"a.{c}").alias(c) for c in attributes), "seq")


def add_node(nodes: DataFrame, node: str, schema: str | None = None, row_count_estimate: int | None = None, last_updated: str | None = None, seq: list[int] | None = None) -> DataFrame:
    new = nodes.sparkSession.createDataFrame([(node, schema, row_count_estimate, last_updated, True, seq or [1 << 62])], NODE_SCHEMA)
    return upsert_nodes(nodes, new)


def graph_of(records: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of lineage records (text_id, stmt, target_table, source_tables, ...), all at once."""
    base = records.select(F.col("text_id").cast("bigint").alias("t"), F.col("stmt").cast("bigint").alias("s"), "*")
    source = base.select("*", F.posexplode("source_tables").alias("pos", "src"))
    seq = lambda pos: F.array("t", "s", pos.cast("bigint"))
    edges = source.select("src", F.col("target_table").alias("dst"), F.col("column_mappings").cast(MAPPINGS).alias("column_mappings"), "transformation_type", "pipeline_name", seq(F.col("pos")).alias("seq"))
    # targets and sources from one reading of the records
    own = F.struct(F.col("target_table").alias("node"), F.lit(-1).alias("pos"), (F.col("target_table").isNotNull() & (F.size("source_tables") > 0)).alias("fed"))
    read = F.transform(F.coalesce("source_tables", F.array().cast("array<string>")), lambda x, i: F.struct(x.alias("node"), i.alias("pos"), F.lit(False).alias("fed")))
    named = base.select("t", "s", F.inline(F.concat(F.array(own), read))).select("node", seq(F.col("pos")).alias("seq"), "fed")
    first = named.groupBy("node").agg(F.min("seq").alias("seq"), F.bool_or(F.coalesce("fed", F.lit(False))).alias("fed"))
    nodes = first.select(
        "node", F.lit(None).cast("string").alias("schema"), F.lit(None).cast("bigint").alias("row_count_estimate"),
        (F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("last_updated"), (~F.col("fed")).alias("is_source"), "seq",
    )
    return nodes, upsert_edges(edges)


def ingest(nodes: DataFrame, edges: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with more records; is_source is kept up."""
    new_nodes, new_edges = graph_of(records)
    edges = upsert_edges(edges, new_edges)
    fed = edges.select(F.col("dst").alias("node")).distinct().withColumn("fed", F.lit(True))
    both = upsert_nodes(nodes, new_nodes).join(fed, "node", "left")
    return both.withColumn("is_source", F.col("is_source") & F.col("fed").isNull()).drop("fed"), edges


def ingest_delta(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(tables_added, edges_added)."""
    tables = after[0].join(before[0], "node", "left_anti").agg(F.count("*").alias("tables_added"))
    edges = after[1].join(before[1], ["src", "dst"], "left_anti").agg(F.count("*").alias("edges_added"))
    return tables.crossJoin(edges)  # one row each


def _roots(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node, node)], "root string, node string")


def _described(found: DataFrame, nodes: DataFrame, direct: DataFrame) -> DataFrame:
    flagged = found.join(direct.withColumn("direct", F.lit(True)), "node", "left")
    return flagged.join(nodes, "node", "left").select("node", F.coalesce("direct", F.lit(False)).alias("direct"), "hop", *(c for c in nodes.columns if c != "node"))


def upstream(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """All ancestors with a flag for direct ones and their attributes; none for an unknown node."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(back, _roots(edges, node), paths=False).where(F.col("node") != node)
    return _described(found, nodes, edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct())


def downstream(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """All descendants, likewise."""
    found = reach(edges, _roots(edges, node), paths=False).where(F.col("node") != node)
    return _described(found, nodes, edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct())


def impact_analysis(edges: DataFrame, node: str) -> DataFrame:
    """(node, hop, path): descendants by distance with one shortest path each, ordered."""
    return reach(edges, _roots(edges, node)).where(F.col("node") != node).select("node", "hop", "path").orderBy("hop", "node")


def closure_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, upstream_count, downstream_count) of every node from one traversal."""
    n = parts(edges, nodes)
    names = keyed(nodes.select("node").distinct(), "node", n)
    ids = kept(names.select("node", F.monotonically_increasing_id().alias("id")), n)
    # pairs of numbers take a fraction of the room and time that pairs of names take
    a, b = ids.select(F.col("node").alias("src"), F.col("id").alias("a")), ids.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    links = kept(edges.select("src", "dst").repartition(n, "src").join(a, "src", "left").repartition(n, "dst").join(b, "dst", "left").select("a", "b"), n)
    if links.where("a IS NULL OR b IS NULL").isEmpty():
        links = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    else:  # edges between unknown nodes lead on, too
        links, ids = edges, names.withColumn("id", F.col("node"))
    pairs = reach(links, ids.select(F.col("id").alias("root"), F.col("id").alias("node")), paths=False).where("root <> node")
    down = pairs.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("downstream_count"))
    up = pairs.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("upstream_count"))
    found = ids.join(up, "id", "left").join(down, "id", "left").select("node", "upstream_count", "downstream_count")
    return nodes.select("node").join(found, "node", "left").na.fill(0)


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) in an order in which edges lead forward; the nodes' own order if there is a cycle."""
    levels = topological_levels(nodes.select("node"), edges).join(nodes.select("node", "seq"), "node")
    cyclic = not levels.where("level is null").isEmpty()
    return (levels.orderBy("seq", "node") if cyclic else levels.orderBy("level", "seq", "node")).select("node", "level")


def edge_lineage(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Column mappings of one edge, a row each; no row without the edge."""
    return edges.where((F.col("src") == src) & (F.col("dst") == dst)).select(F.inline("column_mappings"))


def all_tables(nodes: DataFrame) -> DataFrame:
    return nodes.select("node").orderBy("node")


def node_metadata(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("node") == node)


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a row for each node and edge, ready to be written as text."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def end_to_end_paths(edges: DataFrame, src: str, dst: str, max_hops: int | None = None) -> DataFrame:
    return simple_paths(edges, src, dst, max_hops)
