"""A candidate sweep: quasi-random draw, exact and near-duplicate gates, proxy score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import content_key
from ..operators.joins import anti_seen, enumerate_decorations
from ..operators.selection import elite_pool, halton_sample
from ..operators.similarity import leader_filter
from ..operators.windows import dedup_first
from ..runtime import materialise


def sweep(library: DataFrame, seen: DataFrame, text: str, fp: str, score: Column, order, start: int, n: int,
          t: float = 0.85, sets: Column | None = None, **how) -> DataFrame:
    """Draw `n` rows from `start` on, drop known and near-known ones, score what is left.

    `sets` is an expression that makes the column `fp`: then it is made for drawn rows only.
    """
    drawn = halton_sample(library, order, n, start, **how).withColumn("key", content_key(text))
    fresh = anti_seen(dedup_first(drawn, ["key"], ["draw"]), seen, "key")
    fresh = fresh if sets is None else materialise(fresh).withColumn(fp, sets)
    return leader_filter(fresh, "draw", fp, ["draw"], t, **how).withColumn("proxy_score", score)


def mutate_elite(pool: DataFrame, score: str, tie, text: str, n: int = 50) -> DataFrame:
    """Decorations of the elite as new candidate rows with their parent's score."""
    best = elite_pool(pool, score, tie, n).withColumnRenamed(score, "parent_score")
    return enumerate_decorations(best).withColumn(text, F.concat(F.col(text), F.col("rgroup")))
