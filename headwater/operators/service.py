"""The answers of a lineage service, as functions over one growing graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.plans.stages import materialise

from . import graph, report
from .sql_extract import parse_sql


class UnknownTable(KeyError):
    """The table isn't in the graph."""


class Service:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.nodes, self.edges = graph.empty_graph(spark)
        self._texts = 0

    def health(self) -> dict:
        return {"status": "ok", "node_count": self.nodes.count(), "edge_count": self.edges.count()}

    def parse(self, sql: str, pipeline_name: str | None = None) -> dict:
        """Add the statements of a text; the number of records and what they added."""
        records = materialise(parse_sql(self.spark, sql, pipeline_name).withColumn("text_id", F.lit(self._texts).cast("bigint")))
        self._texts += 1
        before = self.nodes, self.edges
        after = graph.ingest(*before, records)
        self.nodes, self.edges = materialise(after[0]), materialise(after[1])
        delta = graph.ingest_delta(before, (self.nodes, self.edges)).first()
        return {"parsed_statements": records.count(), **delta.asDict()}

    def _known(self, table: str) -> None:
        if self.nodes.where(F.col("node") == table).isEmpty():
            raise UnknownTable(table)

    def lineage(self, table: str) -> dict[str, DataFrame]:
        self._known(table)
        return {"upstream": self.upstream(table), "downstream": self.downstream(table)}

    def upstream(self, table: str) -> DataFrame:
        return graph.upstream(self.nodes, self.edges, table)

    def downstream(self, table: str) -> DataFrame:
        return graph.downstream(self.nodes, self.edges, table)

    def impact(self, table: str) -> DataFrame:
        self._known(table)
        return graph.impact_analysis(self.edges, table)

    def graph(self) -> DataFrame:
        return graph.as_json(self.nodes, self.edges)

    def tables(self) -> DataFrame:
        return graph.all_tables(self.nodes)

    def mermaid(self, direction: str = "LR") -> str:
        return report.mermaid(self.nodes, self.edges, direction)

    def report(self) -> str:
        return report.html_report(self.nodes, self.edges)
