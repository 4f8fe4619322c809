"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every neighbour above u is tied to the least node of u's neighbourhood. Small star: the
    same for the neighbours below u and u itself. Hot nodes are safe: minima are summed before they move,
    and the join splits large keys."""
    if large:
        from_u = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        from_u = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = from_u.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = from_u.join(least, "u")
    out = tied.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (u, v): the least node that is reachable. Each round is
    stored; the driver sees a count and a checksum only."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        edges = cut(_stars(_stars(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
