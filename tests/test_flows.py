"""Whole flows, streams with restarts, models, and the registered queries against SQL."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from screenwell.catalog.base import OPERATORS, ORACLES, QUERIES
from screenwell.operators import boosting, models as M
from screenwell.plans import best_hits
from screenwell.runtime import fresh_dir
from screenwell.streaming import streams as R
from tests.oracle import compare, connect

SMOKE = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables are absent")


def test_reference_row_counts_from_its_own_time_on(spark):
    rows = [(1, 1.0, "T", "0.1", "zinc15"), (2, 2.0, "T", "0.2", "ref"), (3, 3.0, "T", "0.19", "zinc15"),
            (4, 4.0, "T", "0.1", "zinc15"), (5, 5.0, "U", "0.3", "zinc15"), (6, 6.0, "U", "bad", "zinc15")]
    log = spark.createDataFrame(rows, "id long, ts double, target_id string, boltz_score string, source string")
    targets = spark.createDataFrame([("T", -2.0), ("U", -20.0)], "target_id string, target_score_threshold double")
    for how in ({}, {"group_rows": 0, "partitions": 3}):
        out = best_hits.judge_scores(log, targets, "target_id", "boltz_score", ["ts", "id"], F.col("source") == "ref", **how)
        got = {r["id"]: (r["affinity"], r["effective_threshold"], r["hit"]) for r in out.collect()}
        assert got == {1: (-3.0, -2.0, True), 2: (-6.0, -5.5, True), 3: (-5.7, -5.5, True), 4: (-3.0, -5.5, False),
                       5: (-9.0, -20.0, False)}


def test_stream_goes_on_after_a_stop(spark):
    src, root = fresh_dir(spark, "src"), fresh_dir(spark, "run")
    elite = lambda: R.stream_elite(
        spark.readStream.schema("id long, v double").parquet(src), "v", "id", 3, path=root)
    spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, v double").write.parquet(src)
    assert sorted(r["id"] for r in elite().collect()) == [2, 3, 4]
    spark.createDataFrame([(9, 3.5)], "id long, v double").write.mode("append").parquet(src)
    assert sorted(r["id"] for r in elite().collect()) == [3, 4, 9]
    assert sorted(r["id"] for r in elite().collect()) == [3, 4, 9]


def test_novelty_memory_spans_batches(spark):
    src = fresh_dir(spark, "src")
    schema = "id long, fp array<int>"
    for batch in ([(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [7, 8])], [(4, [1, 2, 3]), (5, [9])]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    assert sorted(r["id"] for r in R.stream_novel(rows, "id", "fp", ["id"], 0.65).collect()) == [1, 3, 5]


def test_refit_starts_when_due(spark):
    src, fits = fresh_dir(spark, "src"), []
    for n in (3, 3, 1, 2):
        spark.range(n).select(F.lit("T").alias("t")).coalesce(1).write.mode("append").parquet(src)
    rows = spark.readStream.schema("t string").option("maxFilesPerTrigger", 1).parquet(src)
    out = R.stream_refit(rows, "t", lambda due, batch: fits.append((batch, due.count())), least=5, grown=3).first()
    assert (out["n"], out["trained_n"], out["fits"], fits) == (9, 9, 2, [(0, 0), (1, 1), (2, 0), (3, 1)])


def appended(spark, src, schema, rows):
    """The rows as one more file of a stream's folder, opened as a stream of a file a batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_keyed_state_goes_on_after_a_stop(spark):
    """Two batches and a restart give what one batch job gives; null keys are a key, nulls sort last; the state is the engine's alone."""
    src, root, schema = fresh_dir(spark, "src"), fresh_dir(spark, "run"), "id long, `a key` string, v double"
    parts = [[(k, "xyz"[k % 2] if k % 5 else None, float(k % 7) if k % 4 else None) for k in range(a, a + 20)] for a in (0, 20, 40)]
    held = []
    for part in parts:
        rows = appended(spark, src, schema, part)
        got = R.stream_last_n(rows, "a key", ["v desc", "id"], 3, root)
        held += part
        want = [r for key in ("x", "y", None) for r in sorted((r for r in held if r[1] == key), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))[:3]]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sorted(os.listdir(root)) == ["out", "progress"]


def test_reference_is_carried_from_batch_to_batch(spark):
    src, root, schema = fresh_dir(spark, "src"), fresh_dir(spark, "run"), "k string, seq long, s double, ref boolean"
    parts = [[("a", 2, 0.2, True), ("a", 1, 0.1, False), ("b", 1, 0.1, None)], [("a", 3, 0.3, False), ("b", 2, None, True), ("b", 3, 0.2, False)],
             [("a", 5, 0.1, False), ("a", 4, 0.1, True)]]
    for part in parts:
        out = R.stream_threshold(appended(spark, src, schema, part), "k", "seq", "s", "ref", own=-9.0, path=root)
    got = {(r["k"], r["seq"]): r["effective_threshold"] for r in out.collect()}
    assert got == {("a", 1): -9.0, ("a", 2): -5.5, ("a", 3): -5.5, ("a", 4): -2.5, ("a", 5): -2.5, ("b", 1): -9.0, ("b", 2): -9.0, ("b", 3): -9.0}


def test_history_forgets(spark):
    """Late rows change nothing, state goes behind the watermark, and only young buckets are shown."""
    src, root, schema = fresh_dir(spark, "src"), fresh_dir(spark, "run"), "ts timestamp, v double, t string"
    at = lambda m: __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(minutes=m)
    sizes = []
    for minutes in (range(0, 60, 4), range(60, 300, 4), range(300, 600, 4), [2, 599]):
        rows = appended(spark, src, schema, [(at(m), float(m % 13) + 100 * (m == 2), None if m % 2 else "T") for m in minutes])
        live = R.stream_history(rows, "ts", "v", "t")
        out = R.drain(live, "update", ["bucket"], root)
        sizes.append(spark.streams.active or out.count())
    shown = R.recent_history(out).collect()
    assert 24 <= len(shown) <= 25 and shown == sorted(shown, key=lambda r: r["bucket"])
    assert len(R.recent_history(out, "8 hours").collect()) == 30
    first = out.orderBy("bucket").first()
    assert first["best_score"] == 4.0  # not 102, which came ten hours late


def test_deduplication_forgets_keys(spark):
    src, root, schema = fresh_dir(spark, "src"), fresh_dir(spark, "run"), "k long, ts timestamp"
    import datetime
    totals = []
    for day in range(6):
        rows = [(day * 100 + i, datetime.datetime(2024, 1, 1 + day, 1)) for i in range(100)]
        rows = appended(spark, src, schema, rows + rows[:50] + ([(k - 100, ts) for k, ts in rows[:10]] if day else []))
        query = (R.stream_dedup(rows, "k", "ts", "36 hours").writeStream.format("noop").option("checkpointLocation", root)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        totals.append(sum(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]))
    assert totals[-1] <= 300 and totals[-1] == totals[-2]


def grown_by_hand(x, y, hashes, train, trees, depth=4, rate=0.05, share=0.8, seed=42):
    """Boosting by plain loops: every cut of every feature is tried. Per tree {place: (feature, cut)} and {place: value}; all predictions."""
    unit = boosting.unit_of(np.array(y))
    cuts = boosting.cut_points(np.array(x, float))
    base = sum(round(y[i] / unit) for i in train) * unit / len(train)
    now, out = [base] * len(y), []
    for tree in range(trees):
        left = [round((v - p) / unit) for v, p in zip(y, now)]
        use = [i for i in train if boosting.drawn(hashes, tree, share, seed)[i]]
        nodes, inner = {0: (use, list(range(len(y))))}, {}
        for level in range(depth):
            for place in range((1 << level) - 1, (2 << level) - 1):
                own, every = nodes.get(place, ([], []))
                best, least = None, boosting.LEAST_GAIN * len(own) + (float(sum(left[i] for i in own)) ** 2 / len(own) if own else 0)
                for j, values in enumerate(cuts):
                    for c in values:
                        sides = [[i for i in own if (x[i][j] > c) == side] for side in (False, True)]
                        if all(sides):
                            gain = sum(float(sum(left[i] for i in s)) ** 2 / len(s) for s in sides)
                            if gain > (best[0] if best else least):
                                best = gain, j, c
                _, j, c = best or (0, 0, float("inf"))
                inner[place] = j, c
                for side in (False, True):
                    nodes[2 * place + 1 + side] = tuple([i for i in part if (x[i][j] > c) == side] for part in (own, every))
        leaves = {}
        for place in range((1 << depth) - 1, (2 << depth) - 1):
            own, every = nodes[place]
            leaves[place] = rate * (sum(left[i] for i in own) * unit / len(own)) if own else 0.0
            for i in every:
                now[i] += leaves[place]
        out.append((inner, leaves))
    return base, out, now


FEATURES = "t string, id long, y double, features array<double>, predicted double, n int, key string"


@pytest.fixture(scope="module")
def learnable():
    rng = np.random.default_rng(1)
    rows = []
    for t, n in (("A", 90), ("B", 40), ("few", 12), ("hollow", 35), (None, 40)):
        for i in range(n):
            x = [float(rng.integers(2)), float(np.round(rng.normal(), 1)), float(rng.integers(3)), 7.0]
            rows.append((t, i, 3 * x[0] - x[1] * x[2] + float(np.round(rng.normal(scale=0.1), 2)), None if t == "hollow" and i % 2 else x, None, 1, "k"))
    rows += rows[:5] + [("A", 500, None, [1.0, 1.0, 1.0, 1.0], None, 1, "k"), ("A", 501, float("nan"), [1.0, 1.0, 1.0, 1.0], None, 1, "k")]
    return rows


def by_target(models):
    out = {}
    for r in models.collect():
        out.setdefault(r["t"], {})[r["tree"], r["node"]] = tuple(r)[3:]
    return out


def test_boosting_equals_plain_loops(spark, learnable):
    df = spark.createDataFrame(learnable, FEATURES)
    models, report = M.train_targets(df, "t", "y", "id", maxIter=8)
    assert {r["t"]: (r["status"], r["n"], r["r2"] is None) for r in report.collect()} == {
        "A": ("ready", 90, False), "B": ("ready", 40, False), "few": ("learning", 12, True), "hollow": ("failed", 35, True)}
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).distinct().collect()}
    table, scored = by_target(models), M.with_predictions(df.drop("predicted"), models, "t")
    predictions = {(r["t"], r["id"]): r["predicted"] for r in scored.collect()}
    r2 = {r["t"]: r["r2"] for r in report.collect()}
    for t, folds in (("A", 5), ("B", 4)):
        rows = [r for r in learnable if r[0] == t][:90 if t == "A" else 40]
        x, y, h = [r[3] for r in rows], [r[2] for r in rows], np.array([hashes[r[1]] for r in rows])
        base, trees, now = grown_by_hand(x, y, h, range(len(y)), 8)
        assert table[t][-1, 0] == (4, None, base)
        for k, (inner, leaves) in enumerate(trees):
            assert {p: table[t][k, p] for p in range(31)} == {**{p: (j, c, None) for p, (j, c) in inner.items()}, **{p: (None, None, v) for p, v in leaves.items()}}
        assert [predictions[t, r[1]] for r in rows] == now
        each = []
        for fold in range(folds):
            test = [i for i in range(len(y)) if h[i] % folds == fold]
            _, _, p = grown_by_hand(x, y, h, [i for i in range(len(y)) if i not in test], 8)
            mean = sum(y[i] for i in test) / len(test)
            each.append(1 - sum((y[i] - p[i]) ** 2 for i in test) / sum((y[i] - mean) ** 2 for i in test))
        assert abs(r2[t] - sum(each) / folds) < 1e-4
    assert predictions["few", 0] is None and predictions[None, 0] is None and predictions["hollow", 0] is None


def test_large_targets_get_the_same_trees(spark, learnable, monkeypatch):
    """Grown level by level over many chunks, or each in one task: the same table, the same R2."""
    df = spark.createDataFrame(learnable, FEATURES).repartition(5)
    small = [x.collect() for x in M.train_targets(df, "t", "y", "id", maxIter=3)]
    monkeypatch.setattr(M, "LOCAL_CELLS", 200)  # A has 360 cells, B 160
    large = [x.collect() for x in M.train_targets(df, "t", "y", "id", maxIter=3)]
    assert [sorted(map(str, x)) for x in large] == [sorted(map(str, x)) for x in small]


def test_models_of_nothing(spark, learnable):
    models, report = M.train_targets(spark.createDataFrame([], FEATURES), "t", "y", "id")
    assert models.collect() == [] and report.collect() == []
    rows = spark.createDataFrame(learnable[:20], FEATURES)
    assert M.cv_r2(spark.createDataFrame([], FEATURES), "y", "id", maxIter=2) == 0.0
    assert M.prescreen(rows.drop("predicted"), models, "t", "id", 5).filter("predicted is null").count() == 5
    same = rows.withColumn("y", F.lit(2.0))
    models, report = M.train_targets(same, "t", "y", "id", min_rows=5, maxIter=2)
    assert report.first()["r2"] == 0.0 and {r["value"] for r in models.filter("tree >= 0 and value is not null").collect()} == {0.0}


def test_models_learn_and_are_kept(spark):
    rows = spark.range(120).select("id", F.lit("T").alias("t"), (F.col("id") % 12).cast("double").alias("mw"),
                                   F.array((F.col("id") % 8).cast("int")).alias("fp"))
    rows = M.assemble(rows.withColumn("y", F.col("mw") * 2), "fp", 8, ("mw",))
    few = rows.filter("id < 10").withColumn("t", F.lit("small"))
    models, report = M.train_targets(rows.unionByName(few), "t", "y", "id", folds=2, maxIter=10)
    got = {r["t"]: (r["status"], r["n"]) for r in report.collect()}
    assert got == {"T": ("ready", 120), "small": ("learning", 10)}
    assert report.filter("t = 'T'").first()["r2"] > 0.3
    best = M.prescreen(rows, models, "t", "id", 5).join(rows.select("id", "y"), "id")
    assert best.agg(F.min("y")).first()[0] >= 18
    assert M.prescreen(few, models, "t", "id", 5).count() == 5
    root = fresh_dir(spark, "models")
    M.save_models(models, root, "t")
    M.save_models(models.filter("tree < 0").withColumn("t", F.lit("07")), root, "t")  # another target's model stays
    again = M.prescreen(rows, M.load_models(spark, root, ["T"]), "t", "id", 5)
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in M.prescreen(rows, models, "t", "id", 5).collect())
    assert M.load_models(spark, root, ["07"]).count() == 1 and M.load_models(spark, root).count() == 1 + models.count()


def traced(run):
    """The most bytes that Python held while `run` ran."""
    import tracemalloc
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_boosting_a_target_takes_few_bytes_a_cell():
    """Histograms are summed over blocks of rows, so that a task holds a target's bins and little else."""
    rng, settings = np.random.default_rng(1), {**M.SETTINGS, "maxIter": 1}
    x = rng.integers(0, 8, (100_000, 50)).astype(float)
    cuts, y, hashes = boosting.cut_points(x[:2000]), x[:, 0] + x[:, 1], rng.integers(-2**62, 2**62, len(x))
    codes = boosting.codes_of(x, cuts)
    assert traced(lambda: boosting.boost(codes, cuts, y, hashes, hashes % 5 != 0, settings)) < 7 * codes.size


def test_chunks_of_a_large_target_are_advanced_one_by_one():
    import pyarrow as pa
    n, chunks, models = 1000, 60, [boosting.FINAL, 0]
    chunk = (0, bytes(8 * n), bytes(8 * n), bytes(n), bytes(30 * n), bytes(16 * n))
    batch = boosting._batch([chunk] * chunks, boosting._CHUNK)
    levels, steps = {(0, m): [[(0, 0, 1, 1, 1, 1)]] for m in models}, {(0, m): np.array([0.5, 2.0]) for m in models}
    seen = []
    assert traced(lambda: seen.extend(b.num_rows for b in boosting._advance({}, models, levels, steps)(iter([batch])))) < batch.nbytes / 4
    assert sum(seen) == chunks
    first = next(boosting._advance({}, models, levels, steps)(iter([batch])))
    assert (np.frombuffer(first.column(5)[0].as_py()) == 0.5).all() and first.column(4)[0].as_py() == chunk[4] and isinstance(first, pa.RecordBatch)


def constant(t, value):
    """A model of one tree of depth 1 that tells features over 4 from others."""
    return [(t, -1, 0, 1, None, value), (t, 0, 0, 0, 4.0, None), (t, 0, 1, None, None, 0.0), (t, 0, 2, None, None, 1.0)]


def test_pool_is_drawn_for_each_trusted_target(spark):
    """Every trusted target meets its own draw of the shared library, and keeps its best; others get none."""
    library = spark.range(1000).select("id", F.array((F.col("id") % 10).cast("double")).alias("features"))
    names = ("small", "large", "doubted", "untrained")
    report = spark.createDataFrame([("small", "ready", 0.9), ("large", "ready", 0.5), ("doubted", "ready", 0.4), ("untrained", "ready", 0.9), ("bad", "failed", None)],
                                   "t string, status string, r2 double")
    models = spark.createDataFrame([r for k, t in enumerate(names[:3]) for r in constant(t, float(k))], f"t string, {boosting.TREE}")
    got = M.prescreen_pool(library, models, report, "t", "id", pool=40, n=30).collect()
    draws = {}
    for r in M.pool_draws(library, report.select("t"), "t", "id", pool=40).collect():
        draws.setdefault(r["t"], set()).add(r["id"])
    assert {len(d) for d in draws.values()} == {40} and draws["small"] != draws["large"]
    for t, base in (("small", 0.0), ("large", 1.0)):
        own = [r for r in got if r["t"] == t]
        assert sorted(r["place"] for r in own) == list(range(1, 31)) and {r["id"] for r in own} <= draws[t]
        high = sum(i % 10 > 4 for i in draws[t])
        assert [r["predicted"] for r in sorted(own, key=lambda r: r["place"])] == [base + 1] * min(30, high) + [base] * (30 - min(30, high))
    assert {r["t"] for r in got} == {"small", "large"}
    assert M.prescreen_pool(library.limit(7), models, report, "t", "id", pool=40, n=30).groupBy("t").count().filter("count = 7").count() == 2
    assert M.prescreen_pool(library.limit(0), models, report, "t", "id").count() == 0


@pytest.mark.parametrize("name", ["train_targets", "cv_r2", "prescreen", "prescreen_pool", "saved_models"])
def test_model_queries_take_the_operators_defaults(name):
    """All targets, with the settings, folds and trust of the operators themselves."""
    import inspect
    from screenwell.catalog import flows
    source = inspect.getsource(getattr(flows, name))
    assert not any(f"{word}=" in source for word in ("maxIter", "maxDepth", "folds", "trusted", "pool", "n", "min_rows"))


def test_logged_twice_counts_once(spark):
    rows = spark.createDataFrame([("T", "C", "0.5"), ("T", "C", "0.5"), ("T", "N", "-1"), ("T", "O", "x")], "t string, m string, s string")
    assert M.training_rows(rows, "t", "m", "s").count() == 1


def test_every_query_names_an_operator():
    assert set(OPERATORS) == set(QUERIES) and set(ORACLES) <= set(QUERIES)


@needs_tables
def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["event_type", "event_id", "user_id", "value", "affinity"] and df.count() > 0


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SMOKE, QUERIES[name], ORACLES[name]) is None


def test_stream_history_query_returns_every_bucket(spark):
    from screenwell.catalog.base import QUERIES
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").filter("value is not null")
    want = {r[0] for r in events.select((F.unix_seconds(F.col("ts").cast("timestamp")) / 21600).cast("long") * 21600).distinct().collect()}
    assert len(want) > 30
    assert {r["bucket_s"] for r in QUERIES["stream_history"](spark, folder).collect()} == want
