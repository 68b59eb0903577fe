"""Exact joins: enrichment, membership, as-of thresholds, anti joins, consensus and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import as_list, fits_broadcast, sort_cols
from .ordering import last_known


def salted_join(left: DataFrame, right: DataFrame, on, how: str = "left", salts: int = 32) -> DataFrame:
    """Equi-join where a few left keys are hot: left rows of a key spread over `salts` tasks,
    each right row is repeated that often. Not for right or full outer joins."""
    on = as_list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    hashable = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")


def enrich(df: DataFrame, dim: DataFrame, on, small: int = 32 << 20) -> DataFrame:
    """Left join to a dimension: broadcast when its bytes prove small; beyond that AQE splits skewed keys."""
    return df.join(F.broadcast(dim) if fits_broadcast(dim, small) else dim, as_list(on), "left")


def registered(df: DataFrame, members: DataFrame, on) -> DataFrame:
    return df.join(members.select(*as_list(on)).distinct(), as_list(on), "left_semi")


def unregistered(df: DataFrame, members: DataFrame, on) -> DataFrame:
    return df.join(members.select(*as_list(on)).distinct(), as_list(on), "left_anti")


def anti_seen(df: DataFrame, seen: DataFrame, key) -> DataFrame:
    """Rows whose key was never seen."""
    return df.join(seen.select(*as_list(key)).distinct(), as_list(key), "left_anti")


def restrict_to(df: DataFrame, kept: DataFrame, key) -> DataFrame:
    return df.join(kept.select(*as_list(key)).distinct(), as_list(key), "left_semi")


def unvisited(dim: DataFrame, fact: DataFrame, key: str, order, n: int = 2) -> DataFrame:
    """The first `n` dimension members the fact table never mentions."""
    return anti_seen(dim, fact, key).orderBy(*sort_cols(order)).limit(n)


def effective_threshold(df: DataFrame, keys, order, reference_affinity: str, own_threshold: str,
                        margin: float = 0.5, out: str = "effective_threshold", **how) -> DataFrame:
    """As-of threshold: the latest reference affinity at or before the row plus a margin, else the
    target's own. `keys` holds the target and, if references expire, the refresh period."""
    known = last_known(df, reference_affinity, order, keys, "__ref", **how)
    return known.withColumn(out, F.coalesce(F.col("__ref") + margin, F.col(own_threshold))).drop("__ref")


def improving(children: DataFrame, parents: DataFrame, parent_key: str, key: str, child_score: str,
              parent_score: str) -> DataFrame:
    """Children that score above their parent; `parents` has one row per `key`."""
    known = parents.select(F.col(key).alias(parent_key), F.col(parent_score).alias("parent_score"))
    return children.join(known, parent_key).filter(F.col(child_score) > F.col("parent_score"))


def consensus(submissions: DataFrame, validations: DataFrame, key: str, claim: str, rescore: str,
              validator: str, tolerance: float = 0.05, need: int = 2, part_rows: int = 300_000) -> DataFrame:
    """Per submission: validations, distinct agreeing validators, and whether enough agree.

    Rows are dealt by key into parts of about `part_rows` validations before they are counted, so the memory of a task does not
    grow with the tables; fixed numbers of parts are not merged again.
    """
    parts = max(1, -(-validations.count() // part_rows))
    subs = submissions.select(key, claim).repartition(parts, key)
    both = validations.select(key, rescore, validator).repartition(parts, key).join(subs.hint("merge"), key)
    ok = F.abs(F.col(rescore) - F.col(claim)) <= tolerance * F.abs(F.col(claim))
    votes = both.groupBy(key).agg(F.count(F.lit(1)).alias("n_validations"),
                                  F.countDistinct(F.when(ok, F.col(validator))).alias("n_confirming"))
    return (submissions.join(votes, key, "left")
            .withColumn("n_validations", F.coalesce("n_validations", F.lit(0)))
            .withColumn("n_confirming", F.coalesce("n_confirming", F.lit(0)))
            .withColumn("confirmed", F.col("n_confirming") >= need))


# Decorations tried on every scaffold.
DECORATIONS = ("", "C", "OC", "F", "Cl", "CC", "C(C)C", "C(=O)O", "C(=O)N", "N", "S(=O)(=O)N", "CF",
               "OCC", "C#N", "C(F)(F)F")


def enumerate_decorations(df: DataFrame, decorations=DECORATIONS) -> DataFrame:
    """Every base row once per decoration, with its number."""
    listed = F.array(*[F.lit(d) for d in decorations])
    return df.select("*", F.posexplode(listed).alias("rgroup_idx", "rgroup"))


def fixed_epoch(slot, start: int, length: int):
    """Epoch number of a slot when all epochs are equally long; null before the start."""
    return F.when(F.col(slot) >= start, F.floor((F.col(slot) - start) / length).cast("long"))


def assign_epoch(df: DataFrame, epochs: DataFrame, slot: str, start: str, length: str, name: str, ident: str,
                 **how) -> DataFrame:
    """Range join to non-overlapping epochs of any length: the latest start at or before the slot,
    kept while the slot lies before its end. One ordered pass, no pair of rows compared."""
    facts = df.withColumn("__at", F.col(slot).cast("long")).withColumn("__epoch", F.lit(None).cast(
        f"struct<n:{epochs.schema[name].dataType.simpleString()},until:bigint>"))
    marks = epochs.select(F.col(start).cast("long").alias("__at"),
                          F.struct(F.col(name).alias("n"), (F.col(start) + F.col(length)).cast("long").alias("until"))
                          .alias("__epoch"))
    lined = facts.withColumn("__fact", F.lit(1)).unionByName(
        marks.withColumn("__fact", F.lit(0)), allowMissingColumns=True)
    known = last_known(lined, "__epoch", ["__at", "__fact", ident], (), "__known", **how)
    return (known.filter("__fact = 1")
            .withColumn(name, F.when(F.col("__at") < F.col("__known.until"), F.col("__known.n")))
            .select(*df.columns, name))


def fulfilment(jobs: DataFrame, submissions: DataFrame, keys) -> DataFrame:
    """Every job with whether a submission matches its keys."""
    done = submissions.select(*as_list(keys)).distinct().withColumn("__done", F.lit(True))
    return (jobs.join(done, as_list(keys), "left")
            .withColumn("is_fulfilled", F.coalesce("__done", F.lit(False))).drop("__done"))
