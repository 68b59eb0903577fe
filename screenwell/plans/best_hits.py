"""The screening question end to end: the best hit of every target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_hit, numeric_score, to_affinity
from ..operators.joins import effective_threshold, enrich
from ..operators.windows import best_per_key


def judge_scores(log: DataFrame, targets: DataFrame, target: str, score: str, order, is_reference: Column,
                 own: str = "target_score_threshold", period: str | None = None, **how) -> DataFrame:
    """Calibrate scores, look up thresholds as of each row, flag hits."""
    valid = log.withColumn(score, numeric_score(score)).filter(F.col(score).isNotNull())
    scored = (valid.withColumn("affinity", to_affinity(score))
              .withColumn("__ref_aff", F.when(is_reference, F.col("affinity"))))
    keys = [target, period] if period else [target]
    known = effective_threshold(enrich(scored, targets, target), keys, order, "__ref_aff", own, **how)
    return known.drop("__ref_aff").withColumn("hit", is_hit("affinity", "effective_threshold"))


def best_hit_per_target(log: DataFrame, targets: DataFrame, target: str, score: str, order,
                        is_reference: Column, **how) -> DataFrame:
    judged = judge_scores(log, targets, target, score, order, is_reference, **how)
    return best_per_key(judged.filter("hit"), [target], score, order)
