"""Top-k reports, candidate picking, sampling, unions of candidate sets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quasi import halton
from ..runtime import as_list, attach, materialise, sort_cols, sort_names
from .joins import anti_seen
from .ordering import number_rows
from .windows import dedup_first, top_per_key


def top_n(df: DataFrame, score: str, tie, n: int, null_as: float | None = None) -> DataFrame:
    """Highest scores first; a missing score can stand for a value."""
    value = F.col(score) if null_as is None else F.coalesce(F.col(score), F.lit(null_as))
    return df.orderBy(value.desc_nulls_last(), *sort_cols(tie)).limit(n)


def latest(df: DataFrame, ts: str, tie, n: int, columns=None) -> DataFrame:
    return (df.select(*columns) if columns else df).orderBy(F.desc(ts), *sort_cols(tie)).limit(n)


def history_tail(df: DataFrame, bucket: str, n: int = 30) -> DataFrame:
    """The newest `n` buckets, oldest first."""
    return df.orderBy(F.desc(bucket)).limit(n).orderBy(bucket)


def next_candidates(df: DataFrame, key: str, proxy: str, order, n: int, confirmed: DataFrame | None = None,
                    family: str | None = None, wanted: str | None = None) -> DataFrame:
    """Best candidates that still lack a confirmed score; first row per key."""
    rows = df.filter(F.col(proxy) > 0)
    if wanted is not None:
        rows = rows.filter(F.col(family) == wanted)
    if confirmed is not None:
        rows = anti_seen(rows, confirmed, key)
    return top_n(dedup_first(rows, [key], order), proxy, order, n)


def elite_pool(df: DataFrame, score: str, tie, n: int = 50) -> DataFrame:
    """The best `n` rows above zero, each with the score a newcomer must beat (0 until full)."""
    best = top_n(df.filter(F.col(score) > 0), score, tie, n)
    entry = best.agg(F.when(F.count(F.lit(1)) >= n, F.min(score)).otherwise(0.0)).scalar()
    return best.withColumn("entry_threshold", entry)


def draw_order(key, seed: int = 42) -> Column:
    """A hash of key and seed; samples take the smallest."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in as_list(key)], F.lit(str(seed))))


def sample_n(df: DataFrame, key, n: int, seed: int = 42) -> DataFrame:
    """`n` rows without replacement, the same ones for the same seed: the smallest hashes of key and seed."""
    return df.orderBy(draw_order(key, seed), *as_list(key)).limit(n)


def halton_sample(df: DataFrame, order, n: int, start: int = 0, dim: int = 0, **how) -> DataFrame:
    """Draws start..start+n-1 of a low-discrepancy sequence over the ordered rows.

    A row may be drawn more than once, as in the sequence. Only the columns of `order`, which must be total, are numbered; the
    drawn rows are looked up by them, so the other columns of the rest are written nowhere.
    """
    names = sort_names(order)
    placed = number_rows(df.select(*names), order, (), "__pos", **how)
    size = df.agg(F.count(F.lit(1))).scalar()
    draws = (df.sparkSession.range(start, start + n).withColumnRenamed("id", "draw")
             .withColumn("__pos", F.floor(halton("draw", dim) * size).cast("long") + 1))
    drawn = materialise(draws.join(placed, "__pos").drop("__pos"))
    return attach(F.broadcast(drawn) if n <= 1_000_000 else drawn, df, names, "inner").select("draw", *df.columns)


def pick_candidates(sources: list[tuple[str, DataFrame]], target: str, order, label: str = "method") -> DataFrame:
    """Per target the first row of the first source that has one."""
    ranked = [df.withColumn(label, F.lit(name)).withColumn("__p", F.lit(p))
              for p, (name, df) in enumerate(sources)]
    union = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return top_per_key(union, [target], ["__p", *as_list(order)], 1).drop("__p")


def prioritise(df: DataFrame, tier: str, ident: str, tier_max: int | None = None, n: int | None = None) -> DataFrame:
    """By tier (9 when unknown), then id."""
    t = F.coalesce(F.col(tier), F.lit(9))
    rows = df.filter(t <= tier_max) if tier_max is not None else df
    rows = rows.orderBy(t, ident)
    return rows.limit(n) if n is not None else rows


def merge_candidates(sources: list[tuple[str, DataFrame]], key: str, score: str, order, n: int) -> DataFrame:
    """Union of several methods; the earlier method keeps a shared key; best `n`."""
    ranked = [df.withColumn("method", F.lit(name)).withColumn("__p", F.lit(p))
              for p, (name, df) in enumerate(sources)]
    union = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    one = dedup_first(union, [key], ["__p", *as_list(order)])
    return top_n(one, score, [key], n).drop("__p")


def parent_pool(best: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Top parents, then seeds that are not among them."""
    return (best.withColumn("origin", F.lit("parent"))
            .unionByName(anti_seen(seeds, best, key).withColumn("origin", F.lit("seed"))))


def minus_submitted(df: DataFrame, submitted: DataFrame, key) -> DataFrame:
    return anti_seen(df, submitted, key)


def fragment_pool(df: DataFrame, score: str, tie, fragments: str, parents: int = 10, least: int = 3) -> DataFrame:
    """Distinct fragments of at least `least` characters from the best parents."""
    return (top_n(df, score, tie, parents).select(F.explode(fragments).alias("fragment"))
            .filter(F.length("fragment") >= least).distinct())
