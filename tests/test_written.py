"""How much the similarity operators write beside their result, on sets much larger than what identifies them."""

import os
import random

from pyspark.sql import functions as F

from screenwell.operators import similarity as X
from screenwell.runtime import shared_dir


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def written(spark, run):
    """(result, bytes that checkpoints added)."""
    folder = shared_dir(spark)
    before = size_of(folder)
    return run(), size_of(folder) - before


def large_sets(spark, seed, n=60, length=4000):
    rnd = random.Random(seed)
    base = [sorted(rnd.sample(range(1 << 40), length)) for _ in range(n // 2)]
    rows = [(i, base[i % len(base)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, fp array<long>")


def test_copies_write_no_set(spark):
    rows, df = large_sets(spark, 1)
    df = df.unionAll(spark.sql("SELECT 100L AS id, CAST(array() AS array<bigint>) AS fp UNION ALL SELECT 101L, NULL"))
    out, size = written(spark, lambda: X.copies(df, "id", "fp").collect())
    assert {(r["id"], r["first_id"]) for r in out} == {(i, i % 30) for i, _ in rows}
    assert size < 60 * 1000  # one set alone has 32 000 bytes


def test_sweep_writes_the_drawn_rows_only(spark):
    from screenwell.plans.sweep import sweep
    library = spark.range(3000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.md5(
        F.concat(F.col("id").cast("string"), k.cast("string"))))).alias("text"))
    seen = spark.createDataFrame([("no such key",)], "key string")
    fp = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    out, size = written(spark, lambda: sweep(library, seen, "text", "fp", F.size("fp"), ["id"], 0, 8, sets=fp, group_rows=100).collect())
    halves = [1500, 750, 2250, 375, 1875, 1125, 2625, 187]  # van der Corput in base 2, over 3000 rows
    assert [r["id"] for r in sorted(out, key=lambda r: r["draw"])] == halves
    assert size < 1_000_000  # all texts have 6 000 000 bytes
