"""Running values over a total order, in parallel even inside one key.

A plain `Window.partitionBy(key)` puts a key into one task. These operators first check the
largest group: if it fits a task the plain window is used; otherwise rows are range-partitioned
by (key, order) so that a hot key spreads over many blocks, each block is summarised, and the
summaries (at most one row per block and key) carry the running value from block to block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import (GROUP_ROWS, as_list, attach, groups_fit, materialise, shuffle_partitions, sort_cols,
                       sort_names)

BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running column. kind: 'count', 'sum' or 'last' (last non-null so far)."""

    out: str
    kind: str
    col: str | None = None


def in_blocks(df: DataFrame, order, keys=(), partitions: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and name each partition in column `__block`.

    Checkpointed, because block summaries and rows are read by separate branches and a second
    run of the range sampling could draw other borders.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *as_list(keys), *sort_cols(order))
    return materialise(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _local(spec: Running, win) -> Column:
    frame = win.rowsBetween(W.unboundedPreceding, 0)
    if spec.kind == "count":
        return F.row_number().over(win).cast("long")
    if spec.kind == "sum":
        return F.sum(spec.col).over(frame)
    return F.last(spec.col, ignorenulls=True).over(frame)


def running(df: DataFrame, specs: list[Running], order, keys=(), *,
            group_rows: int = GROUP_ROWS, partitions: int | None = None) -> DataFrame:
    """Add running columns over `order` within `keys` (none: globally).

    `order` lists columns, each with an optional " desc", and must be total.
    """
    keys, order = as_list(keys), as_list(order)
    if groups_fit(df, keys, group_rows):
        win = W.partitionBy(*keys).orderBy(*sort_cols(order))
        return df.select("*", *[_local(s, win).alias(s.out) for s in specs])

    rows = in_blocks(df, order, keys, partitions)
    by = [*keys, BLOCK]
    win = W.partitionBy(*by).orderBy(*sort_cols(order))
    rows = rows.select("*", *[_local(s, win).alias(s.out) for s in specs])
    kinds = {s.out: rows.schema[s.out].dataType for s in specs}

    ascending = not any(o.lower().endswith(" desc") for o in order)
    at = F.struct(*sort_names(order))
    totals = []
    for s in specs:
        if s.kind == "count":
            totals.append(F.count(F.lit(1)).alias(f"__t_{s.out}"))
        elif s.kind == "sum":
            totals.append(F.sum(s.col).alias(f"__t_{s.out}"))
        elif ascending:
            totals.append(F.max_by(F.col(s.col), F.when(F.col(s.col).isNotNull(), at))
                          .alias(f"__t_{s.out}"))
        else:  # the block's last value, found in order
            rows = rows.withColumn(f"__l_{s.out}", F.last(s.col, ignorenulls=True).over(
                win.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
            totals.append(F.first(f"__l_{s.out}", ignorenulls=True).alias(f"__t_{s.out}"))
    source = rows.groupBy(*by).agg(*totals)

    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = source.select(*by, *[
        (F.last(f"__t_{s.out}", ignorenulls=True) if s.kind == "last" else F.sum(f"__t_{s.out}"))
        .over(before).alias(f"__c_{s.out}") for s in specs])

    out = attach(rows, carried, by)
    for s in specs:
        own, prev = F.col(s.out), F.col(f"__c_{s.out}")
        if s.kind == "last":
            merged = F.coalesce(own, prev)
        else:
            merged = F.when(prev.isNull(), own).otherwise(F.coalesce(own, F.lit(0)) + prev)
        out = out.withColumn(s.out, merged.cast(kinds[s.out]))
    return out.select(*df.columns, *[s.out for s in specs])


def number_rows(df: DataFrame, order, keys=(), out: str = "pos", **how) -> DataFrame:
    """1-based position of every row in `order`, within `keys` or globally."""
    return running(df, [Running(out, "count")], order, keys, **how)


def running_sum(df: DataFrame, value: str, order, keys=(), out: str = "total", **how) -> DataFrame:
    return running(df, [Running(out, "sum", value)], order, keys, **how)


def last_known(df: DataFrame, value: str, order, keys=(), out: str = "last", **how) -> DataFrame:
    """Last non-null `value` at or before each row."""
    return running(df, [Running(out, "last", value)], order, keys, **how)


def rank_pick(df: DataFrame, key: str, value: str, rank: Column, out: str, **how) -> DataFrame:
    """Per key, the value standing at 1-based `rank` (an expression over column `n`) in ascending order.

    Equal values are counted before anything is ordered, so repeats cost no shuffle.
    """
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__times"))
    sizes = counted.groupBy(key).agg(F.sum("__times").alias("n"))
    upto = running_sum(counted, "__times", [value], [key], out="__upto", **how)
    wanted = sizes.withColumn("__rank", rank.cast("long"))
    return (attach(upto, wanted, [key], "inner")
            .filter(F.col("__upto") >= F.col("__rank"))
            .groupBy(key).agg(F.first("n").alias("n"), F.min(value).alias(out)))
