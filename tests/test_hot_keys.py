"""Operators that must split one hot key: forced onto their block path and compared with plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenwell.operators import aggregates as A
from screenwell.operators import joins as J
from screenwell.operators import windows as W
from screenwell.operators.ordering import Running, last_known, number_rows, rank_pick, running

SPLIT = {"group_rows": 0, "partitions": 5}


def log(spark, n=600, seed=1, hot=0.7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else rnd.choice(["a", "b", None])
        rows.append((i, key, rnd.randrange(200), rnd.choice([None, 1, 2, 3, 4]), rnd.randrange(50)))
    return rows, spark.createDataFrame(rows, "id long, key string, ts long, ref long, v long")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("how", [{}, SPLIT])
@pytest.mark.parametrize("keys", [["key"], []])
def test_running(spark, how, keys):
    rows, df = log(spark)
    specs = [Running("n", "count"), Running("s", "sum", "v"), Running("l", "last", "ref")]
    got = {r["id"]: (r["n"], r["s"], r["l"]) for r in running(df, specs, ["ts", "id"], keys, **how).collect()}
    state, want = {}, {}
    for i, key, _, ref, v in ordered(rows):
        k = key if keys else 0
        n, s, last = state.get(k, (0, 0, None))
        state[k] = want[i] = (n + 1, s + v, ref if ref is not None else last)
    assert got == want


@pytest.mark.parametrize("how", [{}, SPLIT])
def test_descending_numbers(spark, how):
    rows, df = log(spark)
    got = {r["id"]: r["pos"] for r in number_rows(df, ["ts desc", "id"], [], "pos", **how).collect()}
    for pos, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        assert got[r[0]] == pos


@pytest.mark.parametrize("n", [9, 10, 11, 57])
@pytest.mark.parametrize("how", [{}, SPLIT])
def test_decile_edges(spark, n, how):
    rnd = random.Random(n)
    values = [float(rnd.randrange(20)) for _ in range(n)]
    df = spark.createDataFrame([("t", v) for v in values], "k string, v double")
    row = A.decile_threshold(df, "k", "v", **how).first()
    want = sorted(values)[max(0, int(n * 0.10) - 1)] if n >= 10 else None
    assert (row["n"], row["threshold"]) == (n, want)


def test_rank_pick_counts_repeats(spark):
    df = spark.createDataFrame([("k", 1.0)] * 5 + [("k", 2.0)] * 5, "k string, v double")
    assert rank_pick(df, "k", "v", F.lit(6), "x", **SPLIT).first()["x"] == 2.0


def test_earlier_smaller():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 2000):
        v = rng.integers(0, 40, n)
        want = [int((v[:i] < v[i]).sum()) for i in range(n)]
        assert W.earlier_smaller(v).tolist() == want


@pytest.mark.parametrize("block", [250_000, 37])
def test_quantile_gate(spark, block):
    rows, df = log(spark, n=500, seed=3)
    df = df.filter("key IS NOT NULL")
    how = {} if block > 1000 else SPLIT
    out = W.running_quantile_gate(df, "key", ["ts", "id"], "v", "id", block_rows=block, **how)
    got = {r["id"]: r["qualifies"] for r in out.collect()}
    history, want = {}, {}
    for i, key, _, _, v in ordered(r for r in rows if r[1]):
        seen = history.setdefault(key, [])
        seen.append(v)
        n = len(seen)
        want[i] = n < 10 or v <= sorted(seen)[max(0, int(n * 0.10) - 1)]
    assert got == want


@pytest.mark.parametrize("interval", [1, 7, 40, 5000])
@pytest.mark.parametrize("group", [500_000, 13])
def test_throttle(spark, interval, group):
    rnd = random.Random(interval)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None]), rnd.randrange(900)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, ts long")
    how = {} if group > 1000 else {"partitions": 4}
    got = sorted((r["key"] or "", r["ts"], r["id"]) for r in W.throttle(df, "key", "ts", interval, "id", group_rows=group, **how).collect())
    want, last = [], {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or ts >= last[key] + interval:
            if key in last and ts == last[key]:
                continue
            last[key] = ts
            want.append((key or "", ts, i))
    assert got == sorted(want)


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_key(spark, n):
    rows, df = log(spark, n=4000, seed=5)
    got = sorted(r["id"] for r in W.top_per_key(df, ["key"], ["v desc", "id"], n).collect())
    want = []
    for key in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[4], r[0]))
        want += [r[0] for r in mine[:n]]
    assert got == sorted(want)


def test_small_top_is_trimmed_before_the_shuffle(spark):
    _, df = log(spark)
    plan = W.top_per_key(df, ["key"], ["v desc", "id"], 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    rows, df = log(spark)
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "key string, w long")
    cols = ["id", "w"] if how in ("inner", "left") else ["id"]
    got = sorted(map(tuple, J.salted_join(df, dim, "key", how, 7).select(*cols).fillna(-1).collect()))
    assert got == sorted(map(tuple, df.join(dim, "key", how).select(*cols).fillna(-1).collect()))


@pytest.mark.parametrize("how", [{}, {"partitions": 3}])
def test_rolling_yield(spark, how):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(1, 9), rnd.randrange(9, 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "b long, d long, q long")
    got = {r["b"]: (r["rolling_rate"], r["window_batches"]) for r in W.rolling_yield(df, "b", "d", "q", **how).collect()}
    for i in range(40):
        part = rows[max(0, i - 4):i + 1]
        assert got[i] == (round(sum(r[1] for r in part) / sum(r[2] for r in part) + 1e-12, 3), len(part))


@pytest.mark.parametrize("how", [{}, {"partitions": 4}])
def test_assign_epoch_leaves_gaps_empty(spark, how):
    epochs = spark.createDataFrame([(1, 0, 10), (2, 10, 5), (3, 100, 10)], "epoch int, start long, len long")
    slots = spark.createDataFrame([(i, s) for i, s in enumerate([0, 9, 10, 14, 15, 99, 100, 109, 110])], "id long, slot long")
    got = {r["slot"]: r["epoch"] for r in J.assign_epoch(slots, epochs, "slot", "start", "len", "epoch", "id", **how).collect()}
    assert got == {0: 1, 9: 1, 10: 2, 14: 2, 15: None, 99: None, 100: 3, 109: 3, 110: None}


@pytest.mark.parametrize("how", [{}, SPLIT])
def test_last_known_descending(spark, how):
    rows, df = log(spark)
    got = {r["id"]: r["last"] for r in last_known(df, "ref", ["ts desc", "id"], ["key"], **how).collect()}
    state, want = {}, {}
    for i, key, _, ref, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        state[key] = want[i] = ref if ref is not None else state.get(key)
    assert got == want


def test_both_paths_give_one_schema(spark):
    df = spark.sql("SELECT id, id % 2 AS k, CAST(id AS DECIMAL(20, 6)) AS v, map('a', id) AS m FROM range(20)")
    window, blocks = (running(df, [Running("s", "sum", "v")], ["id"], ["k"], **how) for how in ({}, SPLIT))
    assert window.schema["s"].dataType == blocks.schema["s"].dataType
    dim = spark.range(2).selectExpr("id AS k", "id * 10 AS x")
    small, large = (sorted((r["id"], r["x"]) for r in J.enrich(df, dim, "k", n).collect()) for n in (10, 1))
    assert small == large and len(small) == 20


def test_quantile_gate_keeps_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, "k", 1, 5.0), (2, "k", 2, None)], "id long, key string, ts long, v double")
    got = {r["id"]: r["qualifies"] for r in W.running_quantile_gate(df, "key", ["ts", "id"], "v", "id").collect()}
    assert got == {1: True, 2: False}


def test_gate_history_holds_all_but_references(spark):
    rows = [(i, "t", float(i % 5), "sweep") for i in range(20)] + [(20, "t", 15.0, "mutant"), (21, "t", -9.0, "ref"), (22, "t", 0.0, "mutant")]
    df = spark.createDataFrame(rows, "id long, target string, v double, source string")
    got = {r["id"]: (r["n"], r["qualifies"]) for r in A.discovery_gate(df, "target", "v", "source").collect()}
    assert got == {20: (22, False), 22: (22, True)}
