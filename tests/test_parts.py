"""Steps whose tasks hold a bounded number of rows, however large the tables."""

from pyspark.sql import functions as F

from screenwell.operators import joins as J


def test_consensus_counts_in_parts_that_grow_in_number(spark):
    subs = spark.range(40).select(F.col("id").alias("k"), F.lit(10.0).alias("claim"))
    vals = spark.range(120).select((F.col("id") % 30).alias("k"), (F.col("id") % 4).alias("who"), F.when(F.col("id") < 60, 10.0).otherwise(20.0).alias("again"))
    out = J.consensus(subs, vals, "k", "claim", "again", "who", part_rows=10)
    assert "hashpartitioning(k" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    got = {r["k"]: (r["n_validations"], r["n_confirming"], r["confirmed"]) for r in out.collect()}
    assert got == {k: (4, 2, True) if k < 30 else (0, 0, False) for k in range(40)}
