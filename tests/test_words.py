"""Similarity of 64-bit words against brute force, and what it writes."""

import random

import pytest
from pyspark.sql import functions as F

from screenwell.operators import words as V
from tests.test_written import written


def table(spark, seed, n=150):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(10)]
    rows = []
    for i in range(n):
        w = rnd.choice(base) if i % 3 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(9)):
            w ^= 1 << rnd.randrange(64)
        rows.append((i, w - (1 << 64) if w >> 63 else w))
    rows += [(n, 0), (n + 1, None)]
    return rows, spark.createDataFrame(rows, "id long, w long")


def sim(a, b):
    a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
    return (a & b).bit_count() / (a | b).bit_count()


@pytest.mark.parametrize("t", [0.45, 0.8])
def test_words(spark, t):
    (rows, df), (memory, mdf) = table(spark, 1), table(spark, 1, 40)
    full, known = [r for r in rows if r[1]], [m[1] for m in memory if m[1]]
    first = {w: i for i, w in reversed(full)}
    want = {(i, j) for w, i in first.items() for v, j in first.items() if i < j and sim(w, v) >= t}
    assert {(r["id_a"], r["id_b"]) for r in V.similar_pairs(df, "id", "w", t).collect()} == want
    new = [r for r in full if all(sim(r[1], m) < t for m in known)]
    assert {r["id"] for r in V.novel(df, mdf, "id", "w", t).collect()} == {r[0] for r in new}

    def greedy(rows):
        kept = []
        for i, w in rows:
            if all(sim(w, k[1]) < t for k in kept):
                kept.append((i, w))
        return {k[0] for k in kept}
    empty = {r[0] for r in rows if not r[1]}
    for block in (7, None):
        assert {r["id"] for r in V.leader_filter(df, "id", "w", ["id"], t, block=block).collect()} == greedy(full) | empty
    assert {r["id"] for r in V.filter_novel(df, mdf, "id", "w", ["id"], t).collect()} == greedy(new)


@pytest.mark.parametrize("name", ["similar_pairs", "novel", "leader_vectors", "filter_novel_vectors"])
def test_word_queries_write_words_only(spark, name):
    from screenwell.catalog.base import QUERIES
    _, size = written(spark, lambda: QUERIES[name](spark, "/root/testdata/sf0.01").count())
    assert size < 120_000  # with prefixes and candidates checkpoints had 164 000 and more


def test_similar_pairs_meet_as_blocks(spark, monkeypatch):
    """Parts and blocks of any size give each pair once, and no two words meet as rows."""
    monkeypatch.setattr(V, "PART", 20)
    monkeypatch.setattr(V, "BLOCK", (3, 5))
    rows, df = table(spark, 5)
    first = {w: i for i, w in reversed([r for r in rows if r[1]])}
    want = {(i, j): sim(w, v) for w, i in first.items() for v, j in first.items() if i < j and sim(w, v) >= 0.45}
    out = V.similar_pairs(df, "id", "w", 0.45)
    got = out.collect()
    assert len(got) == len(want) > 50 and {(r["id_a"], r["id_b"]): r["similarity"] for r in got} == want
    assert not any(x in out._jdf.queryExecution().toString() for x in ("CartesianProduct", "NestedLoop"))
