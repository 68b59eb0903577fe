"""Per-key rows and running values: first, last, top, rolling, quantile gate, throttle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import as_list, attach, groups_fit, largest_group, materialise, sort_cols, sort_names, with_field
from .ordering import Running, last_known, number_rows, running

# Spark drops rows beyond the n-th before the shuffle only up to this n.
_PRESHUFFLE_LIMIT = 1000


def top_per_key(df: DataFrame, keys, order, n: int, rank: str | None = None, salts: int = 64) -> DataFrame:
    """The first `n` rows per key.

    For small n Spark itself trims each map task to n rows per key before the shuffle. For larger
    n the same is done by hand over salted keys, so that a hot key is never sorted whole.
    """
    keys, order = as_list(keys), as_list(order)
    rows = df
    if n > _PRESHUFFLE_LIMIT:
        salt = F.pmod(F.xxhash64(*sort_names(order)), F.lit(salts))
        part = W.partitionBy(*keys, "__salt").orderBy(*sort_cols(order))
        rows = (rows.withColumn("__salt", salt).withColumn("__r", F.row_number().over(part))
                .filter(F.col("__r") <= n).drop("__salt", "__r"))
    name = rank or "__rank"
    out = (rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*sort_cols(order))))
           .filter(F.col(name) <= n))
    return out if rank else out.drop(name)


def dedup_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in `order`."""
    return top_per_key(df, keys, order, 1)


def best_per_key(df: DataFrame, keys, score: str, order) -> DataFrame:
    """One row per key: highest score, first in `order` on a tie."""
    return top_per_key(df, keys, [f"{score} desc", *as_list(order)], 1)


def last_n(df: DataFrame, keys, newest_first, n: int) -> DataFrame:
    """A ring buffer per key: the newest `n` rows."""
    return top_per_key(df, keys, newest_first, n)


def limit_per_key(df: DataFrame, keys, order, n: int) -> DataFrame:
    return top_per_key(df, keys, order, n)


def number_discoveries(df: DataFrame, target: str, order, number: str = "discovery_number",
                       rank: str = "discovery_rank", **how) -> DataFrame:
    """A global sequence number and a number within the target."""
    return number_rows(number_rows(df, order, [target], rank, **how), order, (), number, **how)


def prior_hits(df: DataFrame, target: str, order, out: str = "prior_hits", **how) -> DataFrame:
    return number_rows(df, order, [target], out, **how).withColumn(out, F.col(out) - 1)


def running_totals(df: DataFrame, key: str, order, amount: str, count: str = "screened",
                   total: str = "earned", **how) -> DataFrame:
    """Rows and amount so far, per key."""
    return running(df, [Running(count, "count"), Running(total, "sum", amount)], order, [key], **how)


def rolling_yield(batches: DataFrame, order, delivered: str, requested: str, k: int = 5,
                  out: str = "rolling_rate", **how) -> DataFrame:
    """Delivered over requested in the last `k` batches.

    Each batch adds itself to the k batches that see it, so no window spans the whole log.
    """
    placed = number_rows(batches, order, (), "__pos", **how)
    seen = (placed.select(F.explode(F.sequence(F.col("__pos"), F.col("__pos") + k - 1)).alias("__pos"),
                          F.col(delivered).alias("__d"), F.col(requested).alias("__q"))
            .groupBy("__pos").agg(F.sum("__d").alias("__d"), F.sum("__q").alias("__q"),
                                  F.count(F.lit(1)).cast("int").alias("window_batches")))
    rate = F.when(F.col("__q") > 0, F.round(F.col("__d") / F.col("__q"), 3))
    return placed.join(seen, "__pos").withColumn(out, rate).drop("__pos", "__d", "__q")


# --- running quantile gate ------------------------------------------------------------------

def earlier_smaller(values: np.ndarray) -> np.ndarray:
    """For every element, how many elements before it are strictly smaller."""
    n, base = len(values), 256
    out = np.zeros(n, dtype=np.int64)
    for at in range(0, n, base):
        part = values[at:at + base]
        out[at:at + base] = np.tril(part[None, :] < part[:, None], -1).sum(axis=1)
    width = base
    while width < n:
        for at in range(0, n - width, 2 * width):
            left = np.sort(values[at:at + width])
            out[at + width:at + 2 * width] += np.searchsorted(left, values[at + width:at + 2 * width])
        width *= 2
    return out


def _count_within(rows: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """`out` = earlier rows (by `order`) of the group whose `value` is smaller; groups are bounded."""
    schema = with_field(rows.schema, out, "long")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(**{out: earlier_smaller(pdf[value].to_numpy())})

    return rows.groupBy(*group).applyInPandas(count, schema)


def running_quantile_gate(df: DataFrame, key: str, order, value: str, ident: str, q: float = 0.10,
                          min_n: int = 10, *, block_rows: int = 250_000, **how) -> DataFrame:
    """Judge each row against the nearest-rank quantile of its key's history up to and with itself.

    The value passes when fewer than max(1, floor(n*q)) earlier values are smaller, which is the
    same as being at or below the quantile. Smaller-and-earlier pairs are counted by cutting time
    into blocks and values into buckets: inside a block, inside a bucket across blocks, and by a
    two-way prefix sum over whole block/bucket cells. Every task holds one block or one bucket.
    A row without a value has no counts and does not qualify.
    """
    lean = df.filter(F.col(value).isNotNull()).select(
        ident, F.col(key).alias("__k"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(sort_names(order))],
        F.col(value).alias("__v"))
    placed = number_rows(lean, [c for c in lean.columns if c.startswith("__o")], ["__k"], "__n", **how)
    # Equal values: the later one sorts first, so it never counts as smaller-and-earlier.
    ranked = number_rows(placed.select(ident, "__k", "__v", "__n"), ["__v", "__n desc"], ["__k"], "__r", **how)
    cells = ranked.select(ident, "__k", "__n", "__r",
                          F.floor((F.col("__n") - 1) / block_rows).alias("__b"),
                          F.floor((F.col("__r") - 1) / block_rows).alias("__c"))
    counted = _count_within(cells, ["__k", "__b"], "__n", "__r", "__below")
    if not groups_fit(lean, ["__k"], block_rows):
        counted = materialise(counted)
        across = _count_within(counted.select(ident, "__k", "__b", "__c", "__r"), ["__k", "__c"], "__r", "__b", "__x")
        filled = counted.groupBy("__k", "__b", "__c").agg(F.count(F.lit(1)).alias("__f"))
        side = counted.groupBy("__k").agg(F.max("__b").alias("__mb"), F.max("__c").alias("__mc"))
        grid = (side.select("__k", F.explode(F.sequence(F.lit(0).cast("long"), "__mb")).alias("__b"), "__mc")
                .select("__k", "__b", F.explode(F.sequence(F.lit(0).cast("long"), "__mc")).alias("__c")))
        before = W.unboundedPreceding, -1
        grid = (attach(grid, filled, ["__k", "__b", "__c"])
                .withColumn("__f", F.sum("__f").over(W.partitionBy("__k", "__b").orderBy("__c").rowsBetween(*before)))
                .withColumn("__f", F.sum("__f").over(W.partitionBy("__k", "__c").orderBy("__b").rowsBetween(*before))))
        counted = (attach(counted, grid, ["__k", "__b", "__c"])
                   .join(across.select(ident, "__x"), ident)
                   .withColumn("__below", F.col("__below") + F.col("__x") + F.coalesce("__f", F.lit(0))))
    n = F.col("__n")
    verdict = counted.select(
        ident, n.alias("n_so_far"), F.col("__below").alias("n_below"),
        ((n < min_n) | (F.col("__below") < F.greatest(F.lit(1), F.floor(n * q)))).alias("qualifies"))
    return attach(df, verdict, [ident]).withColumn("qualifies", F.coalesce("qualifies", F.lit(False)))


# --- throttle ---------------------------------------------------------------------------------

def _walk(times: np.ndarray, start: int, interval: int) -> list[int]:
    taken, i = [], start
    while i < len(times):
        taken.append(i)
        i = int(np.searchsorted(times, times[i] + interval))
    return taken


def throttle(df: DataFrame, key: str, ts_micros: str, interval: int, order=(), *,
             group_rows: int = 500_000, **how) -> DataFrame:
    """Rows accepted when at least `interval` has passed since the key's last accepted row.

    A key that fits a task is walked there. A longer one is cut into segments of time; each
    segment reports where a walk that enters at each possible row would leave it, the segments are
    chained by pointer doubling, and then walked side by side from their known entry.
    """
    keep = df.columns
    # Of rows at the same instant only the first can be accepted.
    heads = dedup_first(df.filter(F.col(ts_micros).isNotNull()), [key, ts_micros], as_list(order) or [ts_micros])

    def walk_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts_micros)
        return pdf.iloc[_walk(pdf[ts_micros].to_numpy(), 0, interval)]

    if largest_group(heads, [key]) <= group_rows:
        return heads.groupBy(key).applyInPandas(walk_all, heads.schema).select(*keep)

    seg = F.floor((F.col("__pos") - 1) / group_rows)
    placed = materialise(number_rows(heads, [ts_micros], [key], "__pos", group_rows=group_rows, **how)
                         .withColumn("__seg", seg).drop("__pos"))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[ts_micros].to_numpy())
        nxt = np.searchsorted(t, t + interval)
        out = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                out[i] = out[nxt[i]]
        entries = min(int(np.searchsorted(t, t[0] + interval)) + 1, len(t))
        return pd.DataFrame({key: pdf[key].iloc[0], "__at": t[:entries], "__leave": out[:entries]})

    key_type = df.schema[key].dataType.simpleString()
    nodes = (placed.select(key, "__seg", ts_micros).groupBy(key, "__seg")
             .applyInPandas(exits, f"`{key}` {key_type}, __at long, __leave long"))
    nodes = materialise(nodes)
    # The next entry at or after leave+interval, found by carrying entries backwards in time.
    asks = nodes.select(key, F.col("__at").alias("__from"), (-(F.col("__leave") + interval)).alias("__t"),
                        F.lit(None).cast("long").alias("__hit"), F.lit(1).alias("__ask"))
    marks = nodes.select(key, F.lit(None).cast("long").alias("__from"), (-F.col("__at")).alias("__t"),
                         F.col("__at").alias("__hit"), F.lit(0).alias("__ask"))
    found = last_known(asks.unionByName(marks), "__hit", ["__t", "__ask", "__from"], [key], "__next",
                       group_rows=group_rows, **how)
    jump = materialise(found.filter("__ask = 1 AND __next IS NOT NULL")
                       .select(key, F.col("__from").alias("__at"), "__next"))
    marked = materialise(nodes.groupBy(key).agg(F.min("__at").alias("__at")))
    size = marked.count()
    while True:
        reached = attach(marked, jump, [key, "__at"], "inner").select(key, F.col("__next").alias("__at"))
        marked = materialise(marked.unionByName(reached).distinct())
        grown = marked.count()
        if grown == size:
            break
        size = grown
        onward = jump.select(key, F.col("__at").alias("__next"), F.col("__next").alias("__then"))
        jump = materialise(attach(jump, onward, [key, "__next"], "inner").select(key, "__at", F.col("__then").alias("__next")))

    entry = marked.select(F.col(key), F.col("__at").alias(ts_micros), F.lit(True).alias("__entry"))
    rows = attach(placed, entry, [key, ts_micros])
    schema = heads.schema

    def walk_segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts_micros)
        at = np.flatnonzero(pdf["__entry"].notna().to_numpy())
        taken = _walk(pdf[ts_micros].to_numpy(), int(at[0]), interval) if len(at) else []
        return pdf.iloc[taken][schema.names]

    return rows.groupBy(key, "__seg").applyInPandas(walk_segment, schema).select(*keep)
