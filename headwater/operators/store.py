"""Snapshots of graphs as Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.plans.closure import first_by

from .graph import EDGE_SCHEMA, NODE_SCHEMA, empty_graph


class Store:
    """Nodes and edges under a path. A write makes a new snapshot and then points at it, so that readers never see half
    of one; the pointer is a one-row table read through Spark, so any store works."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> None:
        """Empty tables, unless there are some."""
        if self._snapshot() is None:
            self.persist(*empty_graph(self.spark))

    def _snapshot(self) -> str | None:
        try:
            rows = self.spark.read.schema("snapshot string, at timestamp").parquet(f"{self.path}/pointer").orderBy(F.desc("at")).limit(1).collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows[0]["snapshot"] if rows else None

    def persist(self, nodes: DataFrame, edges: DataFrame) -> None:
        name = uuid.uuid4().hex
        nodes.write.parquet(f"{self.path}/{name}/nodes")
        edges.write.parquet(f"{self.path}/{name}/edges")
        self.spark.sql("SELECT :n AS snapshot, current_timestamp() AS at", args={"n": name}).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    def load_nodes(self) -> DataFrame:
        return self.spark.read.schema(NODE_SCHEMA).parquet(f"{self.path}/{self._snapshot()}/nodes")

    def load_edges(self) -> DataFrame:
        return self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.path}/{self._snapshot()}/edges")

    def upsert_nodes(self, new: DataFrame) -> None:
        self.persist(upserted_nodes(self.load_nodes(), new), self.load_edges())

    def upsert_edges(self, new: DataFrame) -> None:
        self.persist(self.load_nodes(), upserted_edges(self.load_edges(), new))

    def health(self) -> bool:
        try:
            return self.spark.sql("SELECT 1 AS ok").first()["ok"] == 1 and self._snapshot() is not None
        except Exception:  # noqa: BLE001
            return False


def upserted_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by node."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, ["node"], F.desc("_new"), F.desc("seq")).drop("_new")


def upserted_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of ``new`` replace those of ``old`` by (src, dst): delete, then insert."""
    return old.join(new.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(new)
