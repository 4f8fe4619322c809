"""What breaks if a column or table changes: severity, reasons, paths and hours, level by level."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.plans.closure import first_by
from headwater.plans.stages import keyed, kept, parts

# Fixed values of the model: hours by system and factors by severity.
BASE_HOURS = {"sql": "1.0", "spark": "2.5", "dbt": "0.5", "airflow": "1.5"}
OTHER_HOURS = "1.0"
FACTORS = {"BREAKING": "1.0", "WARNING": "0.4", "OK": "0.0"}
SEVERITIES = ("BREAKING", "WARNING", "OK")
#: Impacted nodes of one line of JSON.
PIECE = 1000

CHANGE_SCHEMA = "change_id string, node string, column_name string, change_type string"
IMPACT_SCHEMA = (
    "change_id string, node string, label string, system string, node_type string, severity string, hop_distance int, "
    "path_from_source array<string>, reason string, fix_hours decimal(10,2), discovery array<array<bigint>>"
)


def changes(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """(change_id, node, column_name, change_type) from tuples of the last three; ids are their numbers."""
    return spark.createDataFrame([(str(i), n, c, t) for i, (n, c, t) in enumerate(rows)], CHANGE_SCHEMA)


def classified(df: DataFrame) -> DataFrame:
    """``df`` (column_name, change_type, column_mappings, hop_distance) with severity and reason. The rules are tried in
    turn: whole table, a mapping that uses the column, a wildcard, nearness."""
    name, kind, hop = F.col("column_name"), F.col("change_type"), F.col("hop_distance")
    mappings = F.coalesce("column_mappings", F.array().cast("array<struct<target_col:string,source_expression:string>>"))
    used = F.get(F.filter(mappings, lambda m: F.contains(F.lower(m["source_expression"]), F.lower(name))), 0)
    star = F.get(F.filter(mappings, lambda m: (F.trim(m["source_expression"]) == "*") | (F.trim(m["target_col"]) == "*")), 0)
    out = df.withColumns({"_used": used, "_star": star})
    used, star = F.col("_used"), F.col("_star")
    hit = used.isNotNull()
    wild = F.trim(star["source_expression"]) == "*"
    text = F.format_string
    rules = (
        (name.isNull(), "BREAKING", text("Whole-table change (%s) propagates downstream", kind)),
        (hit & (kind == "drop"), "BREAKING", text("Column '%s' is dropped; consumed in '%s'", name, used["target_col"])),
        (hit & (kind == "rename"), "BREAKING", text("Column '%s' renamed; mapping '%s' → '%s' will break", name, used["source_expression"], used["target_col"])),
        (hit & (kind == "type_change"), "WARNING", text("Column '%s' type changed; expression '%s' may be incompatible", name, used["source_expression"])),
        (hit, "WARNING", text("Column '%s' modified; review mapping '%s'", name, used["source_expression"])),
        (star.isNotNull() & wild, "WARNING", text("Wildcard SELECT * — may implicitly include '%s'", name)),
        (star.isNotNull(), "WARNING", text("Wildcard SELECT * — column '%s' may be consumed", name)),
        (hop <= 2, "WARNING", text("Indirect consumer at hop %d; review for implicit dependency on '%s'", hop, name)),
    )
    severity = reason = None
    for cond, level, words in rules:
        severity = F.when(cond, level) if severity is None else severity.when(cond, level)
        reason = F.when(cond, words) if reason is None else reason.when(cond, words)
    out = out.withColumns({"severity": severity.otherwise("OK"), "reason": reason.otherwise(text("No direct dependency on '%s' detected at hop %d", name, hop))})
    return out.drop("_used", "_star")


def fix_hours(system: Column, severity: Column, hop: Column) -> Column:
    """Base hours of the system, times the severity's factor, less a tenth for each hop beyond the first, half at least."""
    number = lambda s: F.lit(s).cast("decimal(3,1)")
    base, factor = number(OTHER_HOURS), number("0.0")
    for s, h in BASE_HOURS.items():
        base = F.when(system == s, number(h)).otherwise(base)
    for s, f in FACTORS.items():
        factor = F.when(severity == s, number(f)).otherwise(factor)
    near = F.greatest(number("0.5"), (F.lit(11) - hop).cast("decimal(10,1)") / 10)
    return F.round(base * factor * near, 2).cast("decimal(10,2)")


def simulate(nodes: DataFrame, edges: DataFrame, change: DataFrame) -> DataFrame:
    """Blast radius of any number of changes (CHANGE_SCHEMA) in one traversal.

    Each level joins the frontier with the edges. A node is entered through the edge that comes first by (order in which
    its source was found, edge order); both are carried as an array of edge places, so no global numbering is needed.
    What is classified OK is reported but not followed, nor looked at again."""
    links = edges.select("src", "dst", "column_mappings", F.col("seq").alias("place"))
    n = parts(edges.select("src"), nodes.select("node"))
    links = keyed(links, "src", n)
    facts = keyed(nodes.select("node", "label", "system", "node_type"), "node", n)
    none = F.array().cast("array<array<bigint>>")
    start = change.select("change_id", "node", "column_name", "change_type", F.array("node").alias("path"), none.alias("key")).repartition(n, "node")
    frontier = kept(start.join(facts.select("node"), "node", "left_semi"))
    seen = frontier.select("change_id", "node")
    found, hop = None, 0
    while not frontier.isEmpty():
        hop += 1
        # the frontier lies where the links that leave it do; what they lead to is shuffled once, to where it was seen and described
        step = links.join(frontier.withColumnRenamed("node", "src"), "src").drop("src").withColumnRenamed("dst", "node").repartition(n, "node").join(seen, ["change_id", "node"], "left_anti")
        one = first_by(step, ["change_id", "node"], "key", "place").withColumn("hop_distance", F.lit(hop))
        level = classified(one).join(facts, "node", "left").select(
            "change_id", "node", "label", "system", "node_type", "severity", "hop_distance", F.concat("path", F.array("node")).alias("path_from_source"), "reason",
            fix_hours(F.col("system"), F.col("severity"), F.col("hop_distance")).alias("fix_hours"), F.concat("key", F.array("place")).alias("discovery"), "column_name", "change_type",
        )
        level = kept(level)
        report = level.drop("column_name", "change_type")
        found = report if found is None else found.unionByName(report)
        seen = seen.unionByName(level.select("change_id", "node"))
        frontier = level.where("severity <> 'OK'").select("change_id", "node", "column_name", "change_type", F.col("path_from_source").alias("path"), F.col("discovery").alias("key"))
    return found if found is not None else nodes.sparkSession.createDataFrame([], IMPACT_SCHEMA)


def one_decimal(hours: Column) -> Column:
    """Hours as text with one decimal, rounded as binary fractions are."""
    return F.replace(F.format_number(hours.cast("double"), 1), F.lit(","), F.lit(""))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity)


def in_order(impacted: DataFrame) -> DataFrame:
    return impacted.orderBy("change_id", "hop_distance", severity_rank(F.col("severity")), "discovery")


def totals(change: DataFrame, impacted: DataFrame) -> DataFrame:
    """One row for each change: counts by severity and hours."""
    n = lambda s: F.count_if(F.col("severity") == s)
    per = impacted.groupBy("change_id").agg(F.count("*").alias("total_impacted"), n("BREAKING").alias("breaking_count"), n("WARNING").alias("warning_count"), n("OK").alias("ok_count"), F.sum("fix_hours").cast("decimal(18,2)").alias("total_fix_hours"))
    zero = ("total_impacted", "breaking_count", "warning_count", "ok_count", "total_fix_hours")
    return change.join(per, "change_id", "left").select(F.col("change_id"), F.col("node").alias("changed_node"), F.col("column_name").alias("changed_column"), "change_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero))


def by_system(impacted: DataFrame) -> DataFrame:
    """(change_id, system, BREAKING, WARNING, OK)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return impacted.groupBy("change_id", "system").agg(*(n(s) for s in SEVERITIES)).orderBy("change_id", "system")


def summary(change: DataFrame, impacted: DataFrame) -> DataFrame:
    """(change_id, summary): the report as text."""
    lines = by_system(impacted).groupBy("change_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("system", F.format_string("  %-12s  BREAKING=%d  WARNING=%d", "system", "BREAKING", "WARNING").alias("l")))), lambda x: x.l), "\n").alias("systems")
    )
    head = (
        "=== Blast Radius Report ===\nChanged node  : %s\nChanged column: %s\nChange type   : %s\n\nTotal impacted: %d\n"
        "  BREAKING    : %d\n  WARNING     : %d\n  OK          : %d\n\nEstimated fix : %s hrs\n\nBy system:"
    )
    text = F.format_string(head, "changed_node", F.coalesce("changed_column", F.lit("N/A")), "change_type", "total_impacted", "breaking_count", "warning_count", "ok_count", one_decimal(F.col("total_fix_hours")))
    return totals(change, impacted).join(lines, "change_id", "left").select("change_id", F.concat(text, F.coalesce(F.concat(F.lit("\n"), "systems"), F.lit(""))).alias("summary"))


def as_json(change: DataFrame, impacted: DataFrame) -> DataFrame:
    """(change_id, part, json): JSON lines, since a change may reach more nodes than one text can hold. Part 0 of a change
    has its figures, the parts above it, in their order, up to PIECE impacted nodes each."""
    t = totals(change, impacted)
    head = t.select("change_id", F.lit(0).cast("bigint").alias("part"), F.to_json(F.struct(*(c for c in t.columns if c != "change_id"))).alias("json"))
    order = ("change_id", "hop_distance", severity_rank(F.col("severity")), "discovery")
    lines = impacted.repartitionByRange(parts(impacted), *order).sortWithinPartitions(*order)
    item = F.to_json(F.struct("node", "label", "system", "node_type", "severity", "hop_distance", "path_from_source", "reason", "fix_hours"))
    return head.unionByName(lines.select("change_id", (F.monotonically_increasing_id() + 1).alias("part"), item.alias("json")).mapInArrow(_pieces, "change_id string, part bigint, json string"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, put together by PIECE of one change; a piece has the number of its first row."""
    for b in batches:
        ids, numbers, items = (b.column(i).to_pylist() for i in range(3))
        start = 0
        for end in range(1, len(ids) + 1):
            if end == len(ids) or end - start == PIECE or ids[end] != ids[start]:
                text = '{"impacted_nodes":[' + ",".join(items[start:end]) + "]}"
                yield pa.RecordBatch.from_arrays([pa.array([ids[start]], pa.string()), pa.array([numbers[start]], pa.int64()), pa.array([text], pa.string())], ["change_id", "part", "json"])
                start = end


def top_risk(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """(node, label, system, node_type, out_degree, score): the nodes with most dependants; score is the share of the
    other nodes they feed. The limit is the feature: a top list."""
    degree = edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    total = nodes.agg(F.count("*").alias("total"))
    scored = nodes.join(degree, F.col("node") == F.col("src"), "left").crossJoin(total)  # one row
    d = F.coalesce("out_degree", F.lit(0))
    score = F.when(F.col("total") > 1, F.bround(d / (F.col("total") - 1), 4)).otherwise(F.lit(1.0))
    return scored.select("node", "label", "system", "node_type", d.alias("out_degree"), score.alias("score"), "seq").orderBy(F.desc("score"), "seq").limit(n).drop("seq")
