"""Lineage from a stream of SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from headwater.operators.graph import graph_of
from headwater.operators.sql_extract import extract_sql
from headwater.operators.store import Store, upserted_edges, upserted_nodes


def ingest_stream(texts: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Extract each micro-batch of ``texts`` (text_id, pipeline_name, sql) and merge it into ``store``. A batch that
    is run again after a failure changes nothing more: merging is idempotent."""
    store.create()

    def merge(batch: DataFrame, _: int) -> None:
        nodes, edges = graph_of(extract_sql(batch))
        old = store.load_nodes()
        known = old.join(nodes, "node", "left_anti").unionByName(nodes)  # is_source is set anew from all edges
        all_edges = upserted_edges(store.load_edges(), edges)
        fed = all_edges.selectExpr("dst AS node", "true AS fed").distinct()
        kept = known.join(fed, "node", "left").selectExpr("node", "schema", "row_count_estimate", "last_updated", "fed IS NULL AS is_source", "seq")
        store.persist(upserted_nodes(old.limit(0), kept), all_edges)

    writer = texts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
