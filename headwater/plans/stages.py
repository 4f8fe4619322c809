"""Where iterative plans are cut."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a partition of a relation kept by a key holds, about: so the memory of a task doesn't grow with the relation.
ROWS = 500_000
#: Plans that keep a partitioning: no partitions put together at run time, one key of several is enough to part by, and no
#: broadcast by the sizes that checkpoints guess.
_KEPT = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder of the cluster and go on from there: the plan stays short over many
    rounds, a relation that is read several times is computed once, and a lost executor costs nothing done before.
    A folder of our own is used only where the session names none and all runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = dict(sc.getConf().getAll()).get("spark.checkpoint.dir")
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="headwater-checkpoints-"))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _holding(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parts(*relations: DataFrame) -> int:
    """How many partitions the largest relation is parted into: one for each core, more where they would hold over ROWS.
    What the relations are made of is grouped in many partitions meanwhile; small ones are put together as it runs."""
    spark = relations[0].sparkSession
    cores = spark.sparkContext.defaultParallelism
    with _holding(spark, {"spark.sql.shuffle.partitions": str(max(50 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))}):
        return max(cores, *(-(-r.count() // ROWS) for r in relations))


def keyed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df``, written to the checkpoint folder in ``n`` partitions by ``key`` and sorted by it there. What is joined or
    grouped by the key (and more) within ``kept`` is where it is needed: only what isn't parted alike is shuffled."""
    return kept(df.repartition(n, key).sortWithinPartitions(key), n)


def kept(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df``, made of relations that are ``keyed`` alike, written with the partitioning that it has. ``n``: groups and
    joins that must be shuffled go to so many partitions."""
    with _holding(df.sparkSession, _KEPT | ({"spark.sql.shuffle.partitions": str(n)} if n else {})):
        return materialise(df)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal the rows of a plain scan out to all cores where it has fewer partitions than there are, as a small table in
    one row group has: work on its texts would else stay in one task. With ``rows``, also where partitions would hold more
    than so many on average, so that tasks don't grow with the table. Tables of more partitions are left as they are."""
    found = df.select(F.spark_partition_id().alias("p")).agg(F.max("p").alias("last"), F.count("*").alias("n")).first()
    least = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        least = max(least, -(-found["n"] // rows))
    return df if found["last"] is None or found["last"] + 1 >= least else df.repartition(least)
