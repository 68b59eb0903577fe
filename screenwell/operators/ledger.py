"""Rewards, leaders, consensus status and constraint checks on ledger tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..runtime import as_list, materialise
from .ordering import running_sum
from .windows import dedup_first, prior_hits, top_per_key

# Reward per tier, flat reward for a reference compound, supply and hit schedules.
TIER_REWARD = {1: 1, 2: 5, 3: 25}
REFERENCE_REWARD = 5
SUPPLY_CAP = Decimal(21_000_000)
SUPPLY_MILESTONES = (Decimal(5_250_000), Decimal(10_500_000), Decimal(15_750_000))
HIT_TIERS = ((1000, Decimal("0.50")), (100, Decimal("0.75")))
MONEY = "decimal(20,6)"


def weekly_leaders(df: DataFrame, week: str, target: str, submitter: str, affinity: str, tie) -> DataFrame:
    """The lowest affinity of each week and target, and who reached it."""
    best = top_per_key(df, [week, target], [affinity, *as_list(tie)], 1)
    return best.select(week, target, F.col(submitter).alias("leader"), F.col(affinity).alias("leader_affinity"))


def bonus_due(leaders: DataFrame, week: str, current_week, paid: DataFrame, keys) -> DataFrame:
    """Leaders of closed weeks whose bonus was not paid yet."""
    return leaders.filter(F.col(week) < current_week).join(paid.select(*as_list(keys)).distinct(), as_list(keys),
                                                          "left_anti")


def base_reward(tier, is_reference=None, rewards=TIER_REWARD, flat=REFERENCE_REWARD) -> Column:
    """Reward of a hit by difficulty tier; an unknown tier counts as the lowest."""
    out, t = F, col(tier)
    for k, v in rewards.items():
        out = out.when(t == k, v)
    reward = out.otherwise(rewards[min(rewards)])
    return reward if is_reference is None else F.when(is_reference, flat).otherwise(reward)


def earnings(df: DataFrame, submitter: str, reward: Column) -> DataFrame:
    return df.groupBy(submitter).agg(F.count(F.lit(1)).alias("hits"), F.sum(reward).alias("earned"))


def hit_multiplier(prior) -> Column:
    out, p = F, col(prior)
    for least, factor in HIT_TIERS:
        out = out.when(p >= least, F.lit(factor))
    return out.otherwise(F.lit(Decimal("1.00")))


def halved_rewards(df: DataFrame, order, target: str, base: Column, milestones=SUPPLY_MILESTONES,
                   cap: Decimal = SUPPLY_CAP, **how) -> DataFrame:
    """Reward of every confirmed hit: base x hit multiplier x supply multiplier, up to the supply cap.

    The supply multiplier depends on everything minted before. Let C be the running sum without it:
    until C passes the first milestone minted = C, then minted grows half as fast, and so on. So one
    distributed running sum and one lookup per milestone replace a row-by-row walk.
    """
    prior = prior_hits(df, target, order, "prior_hits", **how)
    full = prior.withColumn("__full", (base.cast("decimal(12,4)") * hit_multiplier("prior_hits")).cast(MONEY))
    run = materialise(running_sum(full, "__full", order, (), "__c", **how))

    start, minted, rate = Decimal(0), Decimal(0), Decimal(1)
    phases = [(start, minted, rate)]
    for m in milestones:
        bound = start + (m - minted) / rate
        crossed = run.filter(F.col("__c") > F.lit(bound)).agg(F.min("__c")).first()[0]
        if crossed is None:
            break
        minted += rate * (crossed - start)
        start, rate = crossed, rate / 2
        phases.append((start, minted, rate))

    before = F.col("__c") - F.col("__full")
    supply, sofar = F, F
    for start, minted, rate in reversed(phases):
        inside = before >= F.lit(start)
        supply = supply.when(inside, F.lit(rate))
        sofar = sofar.when(inside, F.lit(minted) + F.lit(rate) * (before - F.lit(start)))
    room = F.greatest(F.lit(cap) - F.col("minted_before"), F.lit(Decimal(0)))
    return (run.withColumn("supply_multiplier", supply.cast("decimal(6,4)"))
            .withColumn("minted_before", F.least(sofar.cast("decimal(30,6)"), F.lit(cap).cast("decimal(30,6)")))
            .withColumn("reward", F.least((F.col("__full") * F.col("supply_multiplier")).cast("decimal(30,6)"),
                                          room.cast("decimal(30,6)")).cast(MONEY))
            .drop("__full", "__c"))


def result_status(df: DataFrame, validations: str = "n_validations", confirming: str = "n_confirming",
                  required: int = 3, need: int = 2) -> DataFrame:
    """Pending, Validating, Confirmed, or Rejected once all required votes are in without a majority."""
    n, ok = F.col(validations), F.col(confirming)
    return df.withColumn("status", F.when(n == 0, "Pending").when(ok >= need, "Confirmed")
                         .when(n >= required, "Rejected").otherwise("Validating"))


def payable(results: DataFrame, paid: DataFrame, key, status: str = "status") -> DataFrame:
    """Confirmed results that were not paid."""
    return (results.filter(F.col(status) == "Confirmed")
            .join(paid.select(*as_list(key)).distinct(), as_list(key), "left_anti"))


def violations(df: DataFrame, rules: dict[str, Column], keys) -> DataFrame:
    """One row per broken rule: each rule is a condition that holds for a sound row."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return df.select(*as_list(keys), F.explode(broken).alias("violation"))


def submission_rules(affinity: str, target_active: str, status: str, validator_known: str, nth_in_epoch: str) -> dict:
    return {"AffinityNotNegative": F.col(affinity) < 0, "TargetInactive": F.col(target_active),
            "AlreadyFinalised": ~F.col(status).isin("Confirmed", "Rejected"),
            "DuplicateInEpoch": F.col(nth_in_epoch) == 1, "UnknownValidator": F.col(validator_known)}


# Activity kinds that count, assay class, least potency.
ACTIVITY_TYPES = ("IC50", "Ki", "Kd", "EC50")


def eligible_activities(df: DataFrame, potency: str, kind: str, assay: str, kinds=ACTIVITY_TYPES,
                        binding: str = "B", least: float = 6.0) -> DataFrame:
    """Binding activities of a known kind and enough potency, potency as a number with 3 decimals."""
    value = F.col(potency).try_cast("double")
    return (df.filter(F.col(kind).isin(*kinds) & (F.col(assay) == binding) & (value >= least))
            .withColumn(potency, F.round(value, 3)))


def resolve_target(df: DataFrame, key: str, kind: str, order, preferred: str = "SINGLE PROTEIN") -> DataFrame:
    """One target per key: the first of the preferred kind, else the first."""
    ranked = df.withColumn("__other", (F.col(kind) != preferred).cast("int"))
    return dedup_first(ranked, [key], ["__other", *as_list(order)]).drop("__other")


def needs_refresh(keys: DataFrame, cached: DataFrame, key: str, least: int = 5, force: bool = False) -> DataFrame:
    """Keys whose cache holds fewer than `least` rows."""
    n = cached.groupBy(key).agg(F.count(F.lit(1)).alias("cached_rows"))
    state = keys.select(key).distinct().join(n, key, "left").withColumn(
        "cached_rows", F.coalesce("cached_rows", F.lit(0)))
    return state if force else state.filter(F.col("cached_rows") < least)


# Free places, smallest balances to register one device or several.
FREE_PLACES = 20
FUNDED, FUNDED_MULTI = 33_000_000, 100_000_000


def eligibility(accounts: DataFrame, members: DataFrame, key: str, balance: Column, multi: Column | bool = False,
                free_places: int = FREE_PLACES) -> DataFrame:
    """registered, free (places left), funded, or insufficient."""
    known = members.select(key).distinct()
    taken = known.agg(F.count(F.lit(1))).scalar()
    flagged = accounts.join(known.withColumn("__in", F.lit(True)), key, "left")
    least = F.when(multi if isinstance(multi, Column) else F.lit(multi), FUNDED_MULTI).otherwise(FUNDED)
    return flagged.withColumn("eligibility", F.when(F.col("__in"), "registered")
                              .when(taken < free_places, "free").when(balance >= least, "funded")
                              .otherwise("insufficient")).drop("__in")
