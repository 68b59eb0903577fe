"""Registry of named queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of one folder; zone-less timestamps are read as UTC."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        stamps = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields
                  if f.dataType.simpleString() == "timestamp_ntz"}
        return df.withColumns(stamps) if stamps else df


def query(ident: str, sql: str | None = None, name: str | None = None):
    """Register a function (tables) -> DataFrame for operator `ident` of the inventory."""
    def add(fn):
        key = name or fn.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        OPERATORS[key] = ident
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return add
