"""Monitoring reads: score history and feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import iso_ts
from ..operators.selection import history_tail, latest


def score_history(df: DataFrame, seconds: str, score: str, target: str, now: float, span: float = 7200.0,
                  bucket: float = 300.0, n: int = 30) -> DataFrame:
    """Best score per time bucket of the last `span` seconds, oldest first.

    Raw scores are compared and the result is rounded; the earlier row wins a tie.
    """
    recent = df.filter((F.col(seconds) > now - span) & F.col(score).isNotNull())
    best = F.max_by(F.struct(F.col(score).alias("s"), F.coalesce(target, F.lit("?")).alias("t"),
                             F.col(seconds).alias("at")), F.struct(F.col(score), -F.col(seconds)))
    rows = (recent.groupBy(F.floor(F.col(seconds) / bucket).cast("long").alias("bucket")).agg(best.alias("b"))
            .select("bucket", F.round("b.s", 4).alias("best_score"), F.col("b.t").alias("target"),
                    iso_ts("b.at").alias("ts_iso")))
    return history_tail(rows, "bucket", n)


def feed(df: DataFrame, seconds: str, ident: str, n: int, columns) -> DataFrame:
    """Newest rows first."""
    return latest(df, seconds, [ident], n).select(*columns)
