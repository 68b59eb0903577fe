"""Similarity operators against brute force on small random sets with masses of copies."""

import random

import pytest
from pyspark.sql import functions as F

from screenwell.operators import similarity as X


def sets(spark, seed, n=120, vocab=40):
    rnd = random.Random(seed)
    base = [frozenset(rnd.sample(range(vocab), rnd.randrange(3, 12))) for _ in range(12)]
    rows = []
    for i in range(n):
        s = set(rnd.choice(base)) if i % 3 else set(base[0])  # a third are copies or near copies of one set
        if rnd.random() < 0.5:
            s ^= {rnd.randrange(vocab)}
        rows.append((i, sorted(s), rnd.randrange(10)))
    rows.append((n, [], 5))
    return rows, spark.createDataFrame(rows, "id long, fp array<int>, score long")


def sim(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def greedy(rows, t, n=None):
    kept = []
    for r in rows:
        if r[1] and all(sim(r[1], k[1]) < t for k in kept):
            kept.append(r)
            if n and len(kept) == n:
                break
    return [k[0] for k in kept]


@pytest.mark.parametrize("t", [0.4, 0.65, 0.85, 1.0])
def test_pairs(spark, t):
    rows, df = sets(spark, 1)
    first = {}
    for r in rows:
        if r[1]:
            first.setdefault(tuple(r[1]), r[0])
    reps = sorted((i, s) for s, i in first.items())
    want = {(a, b) for a, x in reps for b, y in reps if a < b and sim(x, y) >= t}
    assert {(r["id_a"], r["id_b"]) for r in X.similar_pairs(df, "id", "fp", t).collect()} == want
    links = {r["id"]: r["first_id"] for r in X.copies(df, "id", "fp").collect()}
    assert links == {r[0]: first[tuple(r[1])] for r in rows if r[1]}


@pytest.mark.parametrize("slice_rows", [1, 32])
@pytest.mark.parametrize("t", [0.5, 0.65, 0.9])
def test_novel(spark, t, slice_rows):
    rows, df = sets(spark, 2)
    memory, mdf = sets(spark, 7, n=40)
    want = {r[0] for r in rows if r[1] and any(m[1] and sim(r[1], m[1]) >= t for m in memory)}
    assert {r["id"] for r in X.similar_ids(df, mdf, "id", "fp", t, slice_rows).collect()} == want
    assert {r["id"] for r in X.novel(df, mdf, "id", "fp", t).collect()} == {r[0] for r in rows if r[1]} - want


@pytest.mark.parametrize("visible", [64, 2])
@pytest.mark.parametrize("t", [0.5, 0.85])
def test_leader_filter(spark, t, visible):
    rows, df = sets(spark, 3, n=60)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    got = {r["id"] for r in X.leader_filter(df, "id", "fp", ["score desc", "id"], t, visible=visible).collect()}
    assert got == set(greedy(order, t)) | {60}  # the row without a set resembles none


@pytest.mark.parametrize("n", [4, 50])
def test_diverse_top_n(spark, n):
    rows, df = sets(spark, 4)
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    got = X.diverse_top_n(df, "id", "fp", ["score desc", "id"], 0.5, n)
    assert [r["id"] for r in got.collect()] == greedy(order, 0.5, n)


def test_diverse_top_n_makes_sets_of_a_prefix_only(spark):
    """A mass of copies leads the walk: the prefix grows until n rows are kept, and rows below it are never turned into sets."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def fp(i):
        made.add(1)
        return [1, 2, 3] if i < 1500 else [i, i + 1]
    assert [r["id"] for r in X.diverse_top_n(spark.range(40_000), "id", "fp", ["id"], 0.9, 20, sets=fp("id")).collect()] == [0, *range(1500, 1519)]
    assert made.value < 3 * 5000


@pytest.mark.parametrize("t", [0.4, 0.85])
@pytest.mark.parametrize("block", [1, 7])
def test_hot_tokens_in_blocks(spark, monkeypatch, t, block):
    """Lists cut into blocks give the same pairs, among one table and between two, and no key holds more than two blocks."""
    monkeypatch.setattr(X, "LIST_BLOCK", block)
    test_pairs(spark, t)
    test_novel(spark, 0.65, 32)
    test_leader_filter(spark, t, 64)
    hot = spark.range(4000).selectExpr("id", "7L AS token")
    parts = X._blocks(hot, "id", 100)
    keys = [X._keyed(hot, "id", parts, parts, side, True).groupBy("token", "__i", "__j").count() for side in (0, 1)]
    sizes = [r["count"] for k in keys for r in k.collect()]
    assert max(sizes) < 2 * 100 and len(sizes) == 2 * 40 * 41 // 2


def test_leader_filter_keeps_rows_without_a_set(spark):
    """A row that cannot be read resembles nothing; with a key it is a duplicate of an earlier one of its key."""
    rows = [(1, [], "a"), (2, None, "a"), (3, [1, 2], "a"), (4, [1, 2], "b"), (5, None, "b"), (6, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "id long, fp array<int>, key string")
    keep = lambda **how: sorted(r["id"] for r in X.leader_filter(df, "id", "fp", ["id"], **how).collect())
    assert keep() == [1, 2, 3, 5, 6, 7] and keep(key="key") == [1, 3, 5, 6]
    assert [r["id"] for r in X.diverse_top_n(df, "id", "fp", ["id"], 0.5, 5).collect()] == [3]


def test_documents_without_a_set_stay(spark, monkeypatch):
    """Short, empty and null texts are documents too: unlike all but equal texts. Not one set is fetched by the driver."""
    from types import SimpleNamespace

    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from screenwell.catalog import similar as S
    texts = ["abc", "abc", "", "", None, None, "a longer text of its own", "a longer text of its own", "known"]
    docs = spark.createDataFrame([(i, "en", len(x or ""), x) for i, x in enumerate(texts)], "doc_id long, lang string, n_chars long, text string")
    memory = spark.createDataFrame([("known",), (None,)], "text string")
    t = SimpleNamespace(spark=spark, documents=docs, benchmark=memory, conversations=memory.limit(0))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(S.leader_filter(t)) == [0, 2, 4, 5, 6, 8]
    assert ids(S.novel_documents(t)) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert ids(S.filter_novel(t)) == [0, 2, 4, 5, 6]
    seen, collect = [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: seen.append(self.columns) or collect(self))
    picked = S.diverse_documents(t)
    assert not any("fp" in c for c in seen)
    assert ids(picked) == [0, 2, 4, 5, 6, 8]


def test_filter_novel(spark):
    rows, df = sets(spark, 5, n=60)
    memory, mdf = sets(spark, 8, n=10)
    fresh = [r for r in rows if r[1] and all(not m[1] or sim(r[1], m[1]) < 0.65 for m in memory)]
    got = {r["id"] for r in X.filter_novel(df, mdf, "id", "fp", ["id"], 0.65).collect()}
    assert got == set(greedy(fresh, 0.65))


def test_nearest_active(spark):
    rows, df = sets(spark, 6)
    df = df.withColumnRenamed("score", "target")
    actives = [r for r in rows if r[0] % 4 == 0 and r[2] != 3]
    adf = spark.createDataFrame([(r[2], f"m{r[0]}", r[0], r[1]) for r in actives], "target long, name string, seq long, fp array<int>")
    got = {r["id"]: (r["similarity"], r["closest"], r["is_novel"])
           for r in X.nearest_active(df, adf, "id", "target", "fp", "name", ["seq"], chunk=3).collect()}
    for i, fp, target in rows:
        best, name = 0.0, ""
        for a in actives:
            if a[2] == target and sim(fp, a[1]) > best:
                best, name = sim(fp, a[1]), f"m{a[0]}"
        assert got[i] == (round(best, 6), name, best < 0.4)


def test_nearest_active_skips_what_cannot_win(spark):
    """Sets of very different sizes: the same answers, with fewer than a third of the comparisons; copies, empty and null sets included."""
    rnd = random.Random(9)
    pool = [sorted(rnd.sample(range(4000), n)) for n in [20, 45, 100, 220, 480] * 60]
    actives = [(1, f"m{k}", k, s) for k, s in enumerate(pool)] + [(1, "none", 900, []), (1, "null", 901, None), (2, "other", 902, pool[0])]
    cand = [(k, 1, sorted(set(s[: max(1, len(s) * 9 // 10)]) | {rnd.randrange(4000)})) for k, s in enumerate(pool[:120])] + [(500, 1, []), (501, 1, None), (502, 3, [1]), (503, 1, pool[7])]
    df = spark.createDataFrame(cand, "id long, target long, fp array<int>")
    adf = spark.createDataFrame(actives, "target long, name string, seq long, fp array<int>")
    met = X._nearest(df, adf, "id", "target", "fp", "name", ["seq"], X.tanimoto, 10, F.size)
    met = sum(r["__met"] for r in met.select("id", "__met").collect())
    assert met < len(cand) * len(actives) / 3
    for small in (True, False):
        got = {r["id"]: (r["similarity"], r["closest"]) for r in X.nearest_active(df, adf, "id", "target", "fp", "name", ["seq"], chunk=10 if small else 1000).collect()}
        for i, target, s in cand:
            best, name = 0.0, ""
            for at, n, _, a in actives:
                if at == target and s and a and sim(s, a) > best:
                    best, name = sim(s, a), n
            assert got[i] == (round(best, 6), name)


def test_rarity_stays_out_of_plans(spark):
    """The table of ranks is read from a one-row table, not written into every plan as a constant."""
    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda k: F.xxhash64("id", k)).alias("fp"))
    plan = X._prefixes(rows, "id", "fp", X._rarity([rows], "fp"), 0.8)._jdf.queryExecution().toString()
    assert len(plan) < 20_000
