"""Pipeline code and descriptors from files, through Spark's readers, so that any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

AIRFLOW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("dag_id", "task_id", "operator")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("input_paths", "output_paths", "upstream_task_ids")]
)


def _whole(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame | None:
    """(file, stem, text) of the files under ``path``; None if there is no such folder."""
    try:
        reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
        df = reader.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    name = F.col("_metadata.file_name")
    return df.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


def sql_directory(spark: SparkSession, path: str) -> DataFrame:
    """Texts (text_id, pipeline_name, sql) of the *.sql files, numbered in the order of their names."""
    files = _whole(spark, path, "*.sql")
    if files is None:
        return spark.createDataFrame([], "text_id bigint, pipeline_name string, sql string")
    # only the names pass through the window's one task; texts stay where they are
    numbers = files.select("file").withColumn("text_id", F.row_number().over(Window.orderBy("file")).cast("bigint") - 1)
    return files.join(numbers, "file").select("text_id", F.col("stem").alias("pipeline_name"), F.col("text").alias("sql"))


def schema_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, description, tags) from schema.yml-like files: blocks at "- name:", their first description and tags.
    Later files win."""
    files = _whole(spark, path, "*.yml", recursive=True)
    if files is None:
        return spark.createDataFrame([], "model_name string, description string, tags array<string>")
    blocks = files.select("file", F.posexplode(F.split("text", r"(?=-\s+name:\s*)")).alias("pos", "block")).where(F.col("block").rlike(r"^-\s+name:"))
    got = blocks.select(
        "file",
        "pos",
        F.regexp_extract("block", r"^-\s+name:\s*['\"]?([\w.-]+)", 1).alias("model_name"),
        F.regexp_extract("block", r"description:\s*['\"]?([^'\"\n]*)", 1).alias("description"),
        F.regexp_extract("block", r"tags:\s*\[([^\]]*)\]", 1).alias("tags"),
    )
    tags = F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(F.regexp_replace(t, r"['\"]", ""))), lambda t: t != "")
    order = F.struct("file", "pos")
    last = got.groupBy("model_name").agg(
        F.max_by(F.when(F.col("description") != "", F.trim("description")), F.when(F.col("description") != "", order)).alias("description"),
        F.max_by(F.when(F.col("tags") != "", tags), F.when(F.col("tags") != "", order)).alias("tags"),
    )
    return last


def dbt_project(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, sql, description, tags) of a dbt models folder; empty if it is missing."""
    files = _whole(spark, path, "*.sql", recursive=True)
    if files is None:
        return spark.createDataFrame([], "model_name string, sql string, description string, tags array<string>")
    models = files.select(F.col("stem").alias("model_name"), F.col("text").alias("sql"))
    return models.join(schema_descriptions(spark, path), "model_name", "left")


def script_files(spark: SparkSession, path: str, pipeline_name: str | None = None) -> DataFrame:
    """(pipeline_name, code) of PySpark files; the name is the file's stem unless given."""
    files = _whole(spark, path, "*.py")
    if files is None:
        raise FileNotFoundError(path)
    return files.select((F.lit(pipeline_name) if pipeline_name else F.col("stem")).alias("pipeline_name"), F.col("text").alias("code"))


def airflow_tasks(df_or_rows, spark: SparkSession | None = None) -> DataFrame:
    """Task descriptors from rows (dicts) or a DataFrame, or from a path of JSON lines; defaults filled in, with
    node_id = dag.task."""
    if isinstance(df_or_rows, str):
        df = spark.read.schema(AIRFLOW_SCHEMA).json(df_or_rows)
    elif isinstance(df_or_rows, DataFrame):
        df = df_or_rows
    else:
        df = spark.createDataFrame([tuple(r.get(c) for c in AIRFLOW_SCHEMA.fieldNames()) for r in df_or_rows], AIRFLOW_SCHEMA)
    none = F.array().cast("array<string>")
    return df.select(
        "dag_id", "task_id", F.coalesce("operator", F.lit("PythonOperator")).alias("operator"), *(F.coalesce(c, none).alias(c) for c in ("input_paths", "output_paths", "upstream_task_ids")),
        F.concat_ws(".", "dag_id", "task_id").alias("node_id"),
    )
