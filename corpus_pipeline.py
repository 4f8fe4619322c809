"""From raw documents to packed training sequences: quality rules, exact dedup, n-gram Jaccard join, substring dedup,
packing. Each stage works on all that the one before kept; counts as part of the subpackage llm.

Where rows are lost: quality rules drop documents that a rule rejects; exact dedup drops all but one of equal texts;
the Jaccard join keeps the smallest doc_id of each component; substring dedup cuts repeated passages out of texts (a
document that loses all its words stays, empty). Rows with null text fail the quality rules.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from headwater.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from headwater.llm._common import checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_similar(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = packing.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, spark, added=True)
    return packing.pack(docs, tokenizer)


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_similar),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: Packing and the tokenizer can't be stated in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, through Spark's own access to it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again. A stage's input goes
    once its output is written; that of the last stage, whose result is yet to be read, stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            _drop(spark, f"{folder}/{k - 1}")
