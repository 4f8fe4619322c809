"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def text_bytes(name: str = "text") -> Column:
    """The column as UTF-8 bytes, null as empty; ``bytes.split()`` then yields exactly the words
    ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where the session names none, a folder of our own does if all runs in one
    process; on a cluster other machines couldn't read it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = dict(sc.getConf().getAll()).get("spark.checkpoint.dir")
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="headwater-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage: later steps read the files, so a
    lost executor costs no recomputation of what lies before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table: for wide rows, of which later steps read some columns only."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Like ``stored``, dealt out by ``keys`` as shuffles are: joins and groupings by all of them move the other side only."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = partitions(spark)
    writer = df.repartition(n, *keys).write.option("compression", "zstd").option("path", f"{checkpoint_dir(spark)}/{name}")
    writer.bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
