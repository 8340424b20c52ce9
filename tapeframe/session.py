"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "tapeframe", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with, before Spark joins small ones."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def widen_shuffles(spark: SparkSession, partitions: int) -> None:
    """Let shuffles start with at least so many partitions, so that a task's sort or hash table does not grow with the input.

    Spark joins small ones again; a higher number that is set already stays.
    """
    if partitions > shuffle_parts(spark):
        spark.conf.set(INITIAL_PARTITIONS, str(partitions))


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; unset, a folder of this application in the warehouse, which is shared as well."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tapeframe-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame, key: str) -> DataFrame:
    """``df`` stored once under ``key`` for this and later applications.

    The rows go to a fresh folder and then a small table names that folder, so a write
    that is interrupted or made twice at once leaves nothing half done.  ``key`` must say
    what the rows are made of.
    """
    spark = df.sparkSession
    pointer = f"{shared_base(spark)}/{key}.kept"
    try:
        path = spark.read.schema("path string").parquet(pointer).first().path
    except AnalysisException:
        path = shared_folder(spark, key)
        df.write.parquet(path)
        spark.range(1).select(F.lit(path).alias("path")).write.mode("overwrite").parquet(pointer)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table outlives lost executors, and its readers prune columns.  Who owns the
    shared folder removes it after the application.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
