"""Grouped summaries of logs, workers, coverage and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import NOVEL_SOURCES, REFERENCE_SOURCES, or_general, pct
from ..runtime import as_list, attach
from .ordering import rank_pick


def family_summary(df: DataFrame, family: str, score: str) -> DataFrame:
    return (df.groupBy(or_general(family).alias("family"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("best_score")))


def fleet_totals(workers: DataFrame, count: str, earned: str, power: str) -> DataFrame:
    return workers.agg(F.count(F.lit(1)).alias("workers"), F.sum(count).alias("molecules"),
                       F.sum(earned).alias("earned"), F.sum(power).alias("power"))


def network_totals(accounts: DataFrame, registered: Column, screened: str, activity: DataFrame, hits: str) -> DataFrame:
    """One row: registered members (all active ones if none is registered), screened, hits."""
    members = accounts.agg(F.count(F.when(registered, 1)).alias("__reg"),
                           F.count(F.when(F.col(screened) > 0, 1)).alias("__active"),
                           F.sum(screened).alias("screened"))
    total = activity.agg(F.sum(hits)).scalar()
    return members.select(F.when(F.col("__reg") > 0, F.col("__reg")).otherwise(F.col("__active")).alias("submitters"),
                          "screened", total.alias("hits"))


def active_submitters(df: DataFrame, who: str, slot: str, now_slot: int, span: int = 216_000,
                      approximate: bool = False) -> DataFrame:
    recent = df.filter(F.col(slot) >= now_slot - span)
    count = F.approx_count_distinct if approximate else F.count_distinct
    return recent.agg(count(who).alias("active"))


def rates(df: DataFrame, by, passed: Column, accepted: Column) -> DataFrame:
    """Pass rate of attempts and acceptance rate of passes, in percent."""
    counts = df.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("attempts"), F.count(F.when(passed, 1)).alias("passes"),
        F.count(F.when(passed & accepted, 1)).alias("accepted"))
    return (counts.withColumn("pass_rate", pct("passes", "attempts"))
            .withColumn("accept_rate", pct("accepted", "passes")))


def bit_entropy(df: DataFrame, fp: str, nbits: int, by=()) -> DataFrame:
    """Mean Shannon entropy over the bit positions of a set of fingerprints (0..1)."""
    by = as_list(by)
    valid = df.filter(F.size(fp) > 0)
    sizes = valid.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ones = (valid.select(*by, F.explode(fp).alias("bit")).groupBy(*by, "bit")
            .agg(F.count(F.lit(1)).alias("ones")))
    joined = attach(ones, sizes, by) if by else ones.withColumn("n", sizes.scalar())
    p = F.col("ones") / F.col("n")
    h = F.when(p < 1, -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    return joined.groupBy(*by).agg(F.first("n").alias("n"), (F.sum(h) / nbits).alias("entropy"))


def entropy_check(df: DataFrame, fp: str, nbits: int, least: float = 0.50, by=()) -> DataFrame:
    """Advice only: warn when a batch of more than one is less diverse than `least`."""
    return bit_entropy(df, fp, nbits, by).withColumn("warn", (F.col("n") > 1) & (F.col("entropy") < least))


def contributed(df: DataFrame, who: str, target: str) -> DataFrame:
    """Sorted distinct targets per contributor (as many as there are targets)."""
    return df.groupBy(who).agg(F.sort_array(F.collect_set(target)).alias("targets"))


def decile_threshold(df: DataFrame, key: str, value: str, q: float = 0.10, min_n: int = 10, **how) -> DataFrame:
    """Nearest-rank quantile per key: the value at rank max(1, floor(n*q)); null below `min_n` rows."""
    rank = F.greatest(F.lit(1), F.floor(F.col("n") * q))
    picked = rank_pick(df.filter(F.col(value).isNotNull()), key, value, rank, "threshold", **how)
    return picked.withColumn("threshold", F.when(F.col("n") >= min_n, F.col("threshold")))


def discovery_gate(df: DataFrame, key: str, value: str, source: str, novel=NOVEL_SOURCES, q: float = 0.10,
                   min_n: int = 10, reference=REFERENCE_SOURCES, **how) -> DataFrame:
    """Novel rows at or below their key's threshold; every novel row of a key that is still short.

    The threshold comes from all rows that are no reference, novel or not, a null source included.
    """
    valued = df.filter(F.col(value).isNotNull())
    history = valued.filter(F.col(source).isNull() | ~F.col(source).isin(*reference))
    limits = decile_threshold(history.select(key, value), key, value, q, min_n, **how)
    return attach(valued.filter(F.col(source).isin(*novel)), limits, [key], "inner").withColumn(
        "qualifies", (F.col("n") < min_n) | (F.col(value) <= F.col("threshold")))


def report_rollup(models: DataFrame, status: str = "status") -> DataFrame:
    return models.agg(F.count(F.when(F.col(status) == "ready", 1)).alias("n_ready"),
                      F.count(F.when(F.col(status) == "learning", 1)).alias("n_learning"),
                      F.count(F.when(F.col(status) == "failed", 1)).alias("n_failed"),
                      F.count(F.lit(1)).alias("n_total"))


def coverage(keys: DataFrame, inventory: DataFrame, key: str, failed: DataFrame | None = None) -> DataFrame:
    """How many keys are cached, failed or still missing."""
    state = keys.select(key).distinct().join(
        inventory.select(key).distinct().withColumn("__have", F.lit(True)), key, "left")
    state = (state.join(failed.select(key).distinct().withColumn("__bad", F.lit(True)), key, "left")
             if failed is not None else state.withColumn("__bad", F.lit(None).cast("boolean")))
    have, bad = F.col("__have").isNotNull(), F.col("__bad").isNotNull()
    return state.agg(F.count(F.lit(1)).alias("wanted"), F.count(F.when(have, 1)).alias("cached"),
                     F.count(F.when(~have & bad, 1)).alias("failed"),
                     F.count(F.when(~have & ~bad, 1)).alias("missing"))


def refit_progress(df: DataFrame, by=(), every: int = 50) -> DataFrame:
    n = F.col("n")
    return (df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("since_refit", n % every)
            .withColumn("percent", F.round(F.col("since_refit") * 100.0 / every, 2))
            .withColumn("remaining", every - F.col("since_refit")))


def throughput(df: DataFrame, by, seconds: str, start: float | None = None) -> DataFrame:
    """Thousand items per hour and items per second since the start (first row if none given)."""
    first = F.lit(start) if start is not None else F.min(seconds)
    counted = df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"), (F.max(seconds) - first).alias("__span"))
    hours = F.greatest(F.lit(0.001), F.col("__span") / 3600)
    return (counted.withColumn("khs", F.round(F.col("n") / hours / 1000, 6))
            .withColumn("per_second", F.when(F.col("__span") > 0, F.round(F.col("n") / F.col("__span"), 6)))
            .drop("__span"))


def history_stats(df: DataFrame, by, score: str) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(F.max(score).alias("best"), F.avg(score).alias("mean"))


def validator_stats(df: DataFrame, validator: str, agrees: Column) -> DataFrame:
    """Validations, confirmations and the share confirmed in basis points."""
    return (df.groupBy(validator).agg(F.count(F.lit(1)).alias("total_validations"),
                                      F.count(F.when(agrees, 1)).alias("confirmations"))
            .withColumn("reputation_bps", F.floor(F.col("confirmations") * 10000 / F.col("total_validations"))
                        .cast("int")))


def daily_report(df: DataFrame, day: Column, target: str, affinity: str, hit: Column) -> DataFrame:
    return (df.groupBy(day.alias("day"), target)
            .agg(F.count(F.lit(1)).alias("screened"), F.count(F.when(hit, 1)).alias("hits"),
                 F.min(affinity).alias("best_affinity")))


def leaderboard(df: DataFrame, submitter: str, reward: str, n: int) -> DataFrame:
    """The top submitters by reward; ties go to the smaller name."""
    totals = df.groupBy(submitter).agg(F.count(F.lit(1)).alias("hits"), F.sum(reward).alias("earned"))
    return totals.orderBy(F.desc("earned"), F.asc(submitter)).limit(n)
