"""Sinks: append logs, replace snapshots, register new keys, set failures aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.windows import dedup_first
from ..runtime import fresh_dir


def append_log(df: DataFrame, path: str, fmt: str = "parquet", by=()) -> None:
    """Add rows to a log; `by` names partition columns."""
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a whole snapshot beside the old ones and then point to it.

    Readers follow the pointer, so a run that dies half-way leaves the last snapshot in force, and
    `df` may itself read the snapshot it replaces.
    """
    spark = df.sparkSession
    name = fresh_dir(spark, "snapshot").rsplit("/", 1)[1]
    df.write.parquet(f"{root}/{name}")
    stamp = spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("at"))
    stamp.coalesce(1).write.mode("append").json(f"{root}/_pointer")
    return name


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    last = (spark.read.schema("name STRING, at TIMESTAMP").json(f"{root}/_pointer")
            .agg(F.max_by("name", "at")).first()[0])
    return spark.read.parquet(f"{root}/{last}")


def register_new(existing: DataFrame, incoming: DataFrame, key: str, order) -> DataFrame:
    """The registry with every incoming row whose trimmed key it lacks; first arrival wins."""
    trimmed = incoming.withColumn(key, F.trim(F.col(key))).filter(F.col(key) != "")
    fresh = dedup_first(trimmed, [key], order)
    known = existing.select(F.trim(F.col(key)).alias(key)).distinct()
    return existing.unionByName(fresh.join(known, key, "left_anti"), allowMissingColumns=True)


def quarantine(df: DataFrame, path: str, reason, keep: DataFrame | None = None) -> DataFrame:
    """Write rows with a reason as tab-separated text and return the rows without one."""
    marked = df.withColumn("reason", reason)
    marked.filter(F.col("reason").isNotNull()).write.mode("append").option("sep", "\t").csv(path)
    return marked.filter(F.col("reason").isNull()).drop("reason")
