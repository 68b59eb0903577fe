"""Session helpers: where shared files go, how lineage is cut, how sizes are checked."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# A group at or below this many rows may be handled by one task.
GROUP_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a session that names none (a test on one machine) gets a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="screenwell-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


# With it Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder as Parquet and read back, so columns can be pruned."""
    spark = df.sparkSession
    path, before = fresh_dir(spark, name), spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the biggest group; only partial counts are shuffled."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def groups_fit(df: DataFrame, keys: list[str], rows: int = GROUP_ROWS) -> bool:
    """True if no group of `keys` is larger than one task should hold."""
    return bool(keys) and largest_group(df, keys) <= rows


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table that is read by fewer tasks than there are cores, before costly per-row work.

    A large table already fills the cluster and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def at_most(df: DataFrame, rows: int) -> bool:
    """True if `df` has no more than `rows` rows; stops counting past the bound."""
    return df.limit(rows + 1).count() <= rows


def fits_broadcast(df: DataFrame, size: int = 32 << 20, rows: int = 1_000_000) -> bool:
    """True if `df` has at most `rows` rows and, written as JSON, `size` bytes; stops reading past the bound on rows."""
    head = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("b"))
    n, b = head.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and b <= size


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join the other columns of `right` to `left` on null-safe `keys`."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = functools.reduce(lambda a, b: a & b,
                            [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def as_list(names) -> list:
    if names is None:
        return []
    return [names] if isinstance(names, (str, Column)) else list(names)


def sort_names(order) -> list[str]:
    """Column names of an order such as ["score desc", "id"]."""
    return [o.split()[0] for o in as_list(order)]


def sort_cols(order) -> list[Column]:
    """Sort columns of an order such as ["score desc", "id"]; nulls come last when descending."""
    return [F.desc(o.split()[0]) if o.lower().endswith(" desc") else F.asc(o.split()[0]) for o in as_list(order)]


def with_field(schema: StructType, name: str, kind: str) -> StructType:
    """A copy of `schema` with one more field."""
    return StructType(list(schema.fields)).add(name, kind)
