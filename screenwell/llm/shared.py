"""Spark helpers of the text operators: tables in the shared folder, bounded broadcasts, connected components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..runtime import fresh_dir

# Rows of one or two longs that may be broadcast (32 MB).
BROADCAST_ROWS = 2_000_000
# With it Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back: columns can be pruned and a lost executor costs nothing.

    `by` names a last column whose values get a folder each."""
    spark = df.sparkSession
    path, before = fresh_dir(spark, name), spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by `kept`, once nothing will read them again."""
    for df in tables:
        for path in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]+$", "", f) for f in df.inputFiles()[:1]}:  # a kept table is one folder
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast `small` if counting shows at most `rows` rows; otherwise it is joined by shuffling."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Alternates large-star and small-star, so chains shrink geometrically. Every step is a grouped minimum and a join: a
    node with very many links is summed map-side, and its rows can be split by the join.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct())
        before, last = state, edges
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", "m")).filter("u <> v").distinct()
        edges = kept(small, "links")
        dropped(last)
