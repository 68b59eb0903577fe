"""Per-target gradient-boosted regression: features, fit of all targets at once, check, refit rule, pre-screen.

Models are a table (target, tree, node, feature, cut, value): nodes are numbered as in a heap, rows go left of a cut up to and
with it, leaves hold what they add. The row of tree -1 holds the base value, and the depth of the trees as its feature.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..runtime import at_most, materialise
from .boosting import FINAL, LOCAL_CELLS, fit_large, fit_local
from .ordering import number_rows
from .selection import draw_order
from .windows import top_per_key

# Model settings and rules.
SETTINGS = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}
MIN_ROWS, REFIT_ROWS, MAX_FOLDS, TRUSTED_R2 = 30, 20, 5, 0.5
POOL, KEEP = 10_000, 10
DESCRIPTORS = ("mw", "logp", "hbd", "hba", "tpsa", "rot_bonds", "rings", "heavy_atoms")
# Packed models (of about 100 kB each at 200 trees of depth 4) that a pre-screen may broadcast.
BROADCAST_MODELS = 200


def assemble(df: DataFrame, fp: str, nbits: int, descriptors=DESCRIPTORS, out: str = "features") -> DataFrame:
    """Sparse vector: one slot per fingerprint bit, then the descriptors. No Python per row."""
    spark_bits = CountVectorizerModel.from_vocabulary([str(i) for i in range(nbits)], inputCol="__tokens",
                                                      outputCol="__bits").setBinary(True)
    rows = spark_bits.transform(df.withColumn("__tokens", F.col(fp).cast("array<string>")))
    joined = VectorAssembler(inputCols=["__bits", *descriptors], outputCol=out, handleInvalid="skip").transform(rows)
    return joined.drop("__tokens", "__bits")


def training_rows(df: DataFrame, target: str, molecule: str, score: str) -> DataFrame:
    """Numeric positive scores, each (target, molecule, score) once: scores are logged twice."""
    value = F.col(score).try_cast("double")
    return (df.withColumn(score, value).filter((value > 0) & ~F.isnan(value))
            .dropDuplicates([target, molecule, score]))


def as_array(df: DataFrame, features: str) -> Column:
    return F.col(features) if df.schema[features].dataType.simpleString().startswith("array") else vector_to_array(features)


def _fit(df: DataFrame, target: str, label: str, key: str, features: str, models: list[int], folds: int, min_rows: int, settings: dict) -> tuple[DataFrame, DataFrame]:
    """(target, n, usable, width) and what the fits of the targets with enough usable rows gave."""
    settings, y = {**SETTINGS, **settings}, F.col(label).cast("double")
    once = df.filter(F.col(target).isNotNull() & y.isNotNull() & ~F.isnan(y)).dropDuplicates([target, key, label])
    rows = materialise(once.select(target, F.xxhash64(key).alias("__h"), y.alias("__y"), as_array(df, features).cast("array<double>").alias("__x")))
    counts = rows.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.count("__x").alias("usable"), F.max(F.size("__x")).alias("width"))
    counts = materialise(counts)
    cells = F.col("usable") * F.col("width")
    fit = counts.filter(F.col("usable") >= min_rows)
    large = [r[0] for r in fit.filter(cells > LOCAL_CELLS).select(target).collect()]
    rows = rows.filter("__x is not null")
    small = fit.filter(cells <= LOCAL_CELLS).select(target)
    out = fit_local(rows.join(F.broadcast(small) if at_most(small, 100_000) else small, target), target, models, folds, settings)
    if large:
        out = out.unionByName(fit_large(rows.filter(F.col(target).isin(large)), target, large, models, folds, settings))
    return counts, materialise(out)


def _scores(fits: DataFrame, target: str) -> DataFrame:
    """(target, r2): the mean over the folds, held to [-1, 1]; folds of one label alone say nothing."""
    spread = F.col("squares") - F.col("total") * F.col("total") / F.col("rows")
    each = fits.filter(F.col("fold").isNotNull()).withColumn("r2", F.when(spread > 0, 1 - F.col("errors") / spread))
    return each.groupBy(target).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.avg("r2"), F.lit(0.0)))).alias("r2"))


def cv_r2(df: DataFrame, label: str, key: str, folds: int = MAX_FOLDS, features: str = "features", **settings) -> float:
    """Mean R2 over folds drawn by a hash of the row key, held to [-1, 1]; 0 where nothing can be fitted."""
    _, fits = _fit(df.withColumn("__target", F.lit(0)), "__target", label, key, features, list(range(folds)), folds, 2, settings)
    got = _scores(fits, "__target").first()
    return got["r2"] if got else 0.0


def train_targets(df: DataFrame, target: str, label: str, key: str, min_rows: int = MIN_ROWS, folds: int = MAX_FOLDS,
                  features: str = "features", **settings) -> tuple[DataFrame, DataFrame]:
    """A table of models, one per target with enough rows, and the report (target, status, n, r2).

    Rows of a null target or without a number as label take no part; a (target, key, label) logged twice counts once. A target
    with fewer than `min_rows` rows is learning; one whose rows have fewer features than that failed. All targets are fitted
    in one grouped job, whatever their number; only targets of more than LOCAL_CELLS cells are grown level by level.
    """
    counts, fits = _fit(df, target, label, key, features, [FINAL, *range(folds)], folds, min_rows, settings)
    r2 = _scores(fits, target)
    status = F.when(F.col("n") < min_rows, "learning").when(F.col("usable") < min_rows, "failed").otherwise("ready")
    report = counts.withColumn("status", status).join(r2, target, "left").select(
        target, "status", "n", F.when(F.col("status") == "ready", F.round("r2", 4)).alias("r2"))
    return fits.filter("tree is not null").select(target, "tree", "node", "feature", "cut", "value"), report


def save_models(models: DataFrame, root: str, target: str) -> None:
    """Write every model to a folder of its own; models of other targets stay."""
    models.withColumn("of", _folder(F.col(target))).write.partitionBy("of").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def _folder(target: Column) -> Column:
    return F.concat(F.lit("_"), target.cast("string"))  # read back as a string, whatever the targets are


def load_models(spark: SparkSession, root: str, targets: list | None = None) -> DataFrame:
    """The models under `root`, all or those of some targets."""
    rows = spark.read.option("basePath", root).parquet(root)
    rows = rows if targets is None else rows.filter(F.col("of").isin([f"_{t}" for t in targets]))
    return rows.drop("of")


def packed_models(models: DataFrame, target: str) -> DataFrame:
    """One row per target: base value and depth, and the nodes of all trees as arrays."""
    inner = F.when(F.col("feature").isNotNull() & (F.col("tree") >= 0), F.struct("tree", "node", "feature", "cut"))
    leaf = F.when(F.col("feature").isNull(), F.struct("tree", "node", "value"))
    base = F.col("tree") < 0
    packed = models.groupBy(target).agg(F.max(F.when(base, F.col("value"))).alias("base"), F.max(F.when(base, F.col("feature"))).alias("depth"),
                                        F.array_sort(F.collect_list(inner)).alias("inner"), F.array_sort(F.collect_list(leaf)).alias("leaf"))
    return packed.select(target, F.struct("base", "depth", F.col("inner.feature").alias("features"), F.col("inner.cut").alias("cuts"),
                                          F.col("leaf.value").alias("values")).alias("__model"))


def predicted(x: Column, model: Column) -> Column:
    """The value of one packed model for the features `x`: every tree is a walk through the arrays."""
    nodes = F.call_function("power", F.lit(2), model["depth"]).cast("int")

    def leaf(tree: Column) -> Column:
        def step(node, _):
            at = tree * (nodes - 1) + node
            return 2 * node + F.when(F.get(x, F.get(model["features"], at)) > F.get(model["cuts"], at), 2).otherwise(1)
        return F.aggregate(F.sequence(F.lit(1), model["depth"]), F.lit(0), step)
    trees = F.sequence(F.lit(0), (F.size(model["values"]) / nodes).cast("int") - 1)
    return F.aggregate(trees, model["base"], lambda sum_, t: sum_ + F.get(model["values"], t * nodes + leaf(t) - (nodes - 1)))


def with_predictions(df: DataFrame, models: DataFrame, target: str, features: str = "features") -> DataFrame:
    """`df` with `predicted`, null where the target has no model or the row no features; one join for all targets."""
    packed = packed_models(models, target)
    packed = F.broadcast(packed) if at_most(models.select(target).distinct(), BROADCAST_MODELS) else packed
    x = as_array(df, features)
    both = df.join(packed, target, "left")
    return both.withColumn("predicted", F.when(F.col("__model").isNotNull() & F.col(features).isNotNull(), predicted(x, F.col("__model"))))


def refit_due(counts: DataFrame, report: DataFrame, target: str, n: str = "n", trained_n: str = "trained_n",
              least: int = MIN_ROWS, grown: int = REFIT_ROWS) -> DataFrame:
    """Targets with enough rows that were never trained or gained `grown` rows since."""
    both = counts.join(report.select(target, trained_n), target, "left")
    return both.filter((F.col(n) >= least) & (F.col(trained_n).isNull() | (F.col(n) - F.col(trained_n) >= grown)))


def model_report(counts: DataFrame, previous: DataFrame, target: str, r2: str = "r2", least: int = MIN_ROWS) -> DataFrame:
    """Status per target: learning, failed, ready or improved (better than the previous fit)."""
    before = previous.select(target, F.col(r2).alias("previous_r2"))
    return counts.join(before, target, "left").withColumn(
        "status", F.when(F.col("n") < least, "learning").when(F.col(r2).isNull(), "failed")
        .when(F.col(r2) > F.col("previous_r2"), "improved").otherwise("ready"))


def prescreen(df: DataFrame, models: DataFrame, target: str, key: str, n: int = KEEP, highest: bool = True,
              seed: int = 42, features: str = "features") -> DataFrame:
    """(target, key, predicted, place): the best `n` predicted rows per target.

    A target without a model gets a random `n`, the smallest hashes of key and seed; so does one none of whose rows has features.
    Elsewhere rows without features take no part.
    """
    rows = with_predictions(df, models, target, features).select(target, key, "predicted", draw_order(key, seed).alias("__drawn"))
    value = F.when(F.col("predicted").isNotNull(), F.col("predicted") if highest else -F.col("predicted"))
    rows = rows.withColumn("__value", value).withColumn("__drawn", F.when(F.col("predicted").isNull(), F.col("__drawn")))
    best = top_per_key(rows, [target], ["__value desc", "__drawn", key], n, rank="place")
    scored = F.max("predicted").over(Window.partitionBy(target)).isNotNull()  # over at most n rows a target
    return best.withColumn("__scored", scored).filter(~F.col("__scored") | F.col("predicted").isNotNull()).select(
        target, key, "predicted", F.col("place").cast("int").alias("place"))


def pool_draws(library: DataFrame, targets: DataFrame, target: str, key: str, pool: int = POOL, seed: int = 42) -> DataFrame:
    """(target, key): `pool` rows of a shared library for each target, without replacement; all rows if there are fewer.

    The library is ordered by a hash of key and seed; a target takes `pool` rows in a row from a start that its own hash gives.
    """
    placed = number_rows(library.select(key).withColumn("__draw", draw_order(key, seed)), ["__draw", key], (), "__pos").select(key, "__pos")
    size = library.count()
    start = F.conv(F.substring(draw_order(target, seed), 1, 8), 16, 10).cast("long")
    places = targets.filter(F.lit(size > 0)).select(target, F.explode(F.sequence(F.lit(0), F.lit(max(min(pool, size) - 1, 0)))).alias("i")).select(
        target, (F.pmod(F.col("i") + start, F.lit(max(size, 1))) + 1).alias("__pos"))
    wanted = materialise(places)
    return placed.join(F.broadcast(wanted) if at_most(wanted, 500_000) else wanted, "__pos").select(target, key)


def prescreen_pool(library: DataFrame, models: DataFrame, report: DataFrame, target: str, key: str, pool: int = POOL,
                   n: int = KEEP, trusted: float = TRUSTED_R2, seed: int = 42, features: str = "features") -> DataFrame:
    """Pre-screen `pool` rows of a shared library for each target whose model is ready with a trusted R2; others get no row.

    `library` has a unique key and features and no target. The draw of a target does not depend on the other targets.
    """
    good = report.filter((F.col("status") == "ready") & (F.col("r2") >= trusted)).select(target).join(models.select(target).distinct(), target, "left_semi")
    draws = materialise(pool_draws(library, materialise(good), target, key, pool, seed))
    rows = library.drop(target).join(F.broadcast(draws) if at_most(draws, 500_000) else draws, key)
    return prescreen(rows, models, target, key, n, seed=seed, features=features)
