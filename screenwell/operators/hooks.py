"""Places to plug in code of the caller: pickers, scorers, featurisers, rankers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import with_field
from .selection import pick_candidates, top_n

Strategy = Callable[[DataFrame], DataFrame]


def pick_with(targets: DataFrame, strategies: dict[str, Strategy], target: str, order) -> DataFrame:
    """Ask each strategy for candidates of the targets; the first one that has any for a target wins."""
    return pick_candidates([(name, fn(targets)) for name, fn in strategies.items()], target, order)


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], out: str = "score") -> DataFrame:
    """Run an external scorer over Arrow batches; it gets a frame of the rows and returns one number each."""
    schema = with_field(df.schema, out, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: pd.Series(scorer(batch), index=batch.index).astype("float64")})

    return df.mapInPandas(run, schema)


def featurise_with(df: DataFrame, text: str, featuriser: Callable[[pd.Series], pd.Series], out: str = "fp") -> DataFrame:
    """Run a featuriser text -> on-bits over Arrow batches."""
    @F.pandas_udf("array<int>")
    def bits(s: pd.Series) -> pd.Series:
        return featuriser(s)
    return df.withColumn(out, bits(F.col(text)))


def rank_with(df: DataFrame, ranking: Column, tie, n: int, out: str = "rank_score") -> DataFrame:
    """Order candidates by any expression and keep the best."""
    return top_n(df.withColumn(out, ranking), out, tie, n)
