"""Lexical search, line deduplication and hard negatives against brute force, with nulls, repeats, ties, long texts and odd columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenwell.llm import catalog, gnat, lines, search

WHITE = " \t\n\x0b\x0c\r"
FOLD = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ODD = "doc_id long, text string, term long, rank int, pos int, line string, places string, item long"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", "y", 4) for i, t in rows], ODD).repartition(parts)


# --- search --------------------------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def ranked(docs, items, k):
    whole, held = defaultdict(Counter), []
    for j, (i, text) in enumerate(docs):  # rows of an id are one document; a null id is one for each row
        whole[("null", j) if i is None else i].update(words(text))
    whole = {i: c for i, c in whole.items() if c}
    n_docs, n_terms = len(whole), sum(sum(c.values()) for c in whole.values())
    df = Counter(t for c in whole.values() for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        if i is not None:
            asked[i].update(words(text))
    for i, q in asked.items():
        scores = []
        for d, c in whole.items():
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(k_ * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, k_ in q.items() if c[t])
            if s > 0 and not isinstance(d, tuple):
                scores.append((-s, d))
        held += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(held)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Éé", "naïve", "数据", "X1y"]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(i, pick(rng.randint(1, 40))) for i in range(300)]
    docs += [(400 + k, "same text of all W0 w1") for k in range(60)]  # ties
    docs += [(None, "w0 w1 w59"), (None, None), (500, None), (501, ""), (502, " .,! "), (7, "w3 w3 once more"), (7, "w3 w3 once more"), (503, "w2-W2_w2 " * 4000)]
    items = [(i, pick(12)) for i in range(12)] + [(3, "w1 extra"), (20, None), (21, ""), (22, "unheard of"), (None, "w0"), (23, "w0 w0 W1"), (24, " ".join(f"w{k}" for k in range(60)))]
    return docs, items


@pytest.mark.parametrize("first, most_words, k", [(2, 500_000, 20), (16, 0, 3), (1 << 30, 500_000, 1)])
def test_search_equals_brute_force(spark, corpus, monkeypatch, first, most_words, k):
    """The same rows whatever the size of the blocks, with the words of the items in a dictionary or in a join."""
    monkeypatch.setattr(search, "FIRST_BLOCK", first)
    monkeypatch.setattr(search, "MOST_WORDS", most_words)
    docs, items = corpus
    asked = table(spark, items).withColumnsRenamed({"doc_id": "item_id"})
    got = search.best_matches(table(spark, docs), asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == ranked(docs, items, k)


def test_search_closes_before_the_lists_end(spark, monkeypatch):
    """An item whose best documents stand out is answered from the heads of its lists."""
    monkeypatch.setattr(search, "FIRST_BLOCK", 4)
    docs = [(i, "common " + f"filler{i} " * (3 + i % 50)) for i in range(2000)] + [(3000 + i, "common rare") for i in range(5)]
    seen, keep = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df, name, **more: (seen.append(name), keep(df, name, **more))[1])
    got = search.best_matches(table(spark, docs), table(spark, [(1, "common rare")]).withColumnsRenamed({"doc_id": "item_id"}), 5)
    assert sorted(map(tuple, got.collect())) == ranked(docs, [(1, "common rare")], 5)
    assert seen.count("met") < 4  # the whole list of 2005 entries has six blocks


def test_search_empty(spark):
    none, some = table(spark, []), table(spark, [(1, "a b")])
    rename = lambda df: df.withColumnsRenamed({"doc_id": "item_id"})
    for docs, items in ((none, some), (some, none), (none, none), (some, table(spark, [(1, "c")]))):
        assert search.best_matches(docs, rename(items)).collect() == []


# --- lines ---------------------------------------------------------------------------------------------

def key(line):
    return line.strip(WHITE).translate(FOLD)


def without_repeats(rows, least_chars=10, least_docs=2):
    """Per row its lines, the number dropped and the text kept."""
    holders = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    keeper = {k: min(h - {None}, default=None) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(own), len(own) - len(left), "\n".join(left)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def paragraphs():
    rng = random.Random(3)
    pool = [f"a line that is number {k}" for k in range(40)] + ["short", "", "  ", "ÀÉÎ Ünïcode line", "àéî ünïcode line", "exactly10!"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(60)]
    rows += [(100, "A LINE that is number 3\r\n\t a line that is number 3 \x0b"), (101, None), (102, ""), (103, "\n"), (104, "a line that is number 4\n\n\nend\n"),
             (None, "a line that is number 5\nown line of nobody"), (None, "own line of nobody\nalone"), (5, rows[5][1]), (6, "another text of six\na line that is number 6"),
             (110, "\n".join(f"long text line {k % 9000}" for k in range(30_000))), (111, "\n".join(f"Long Text line {k}" for k in range(0, 20_000, 2))),
             (112, "only repeated here\nonly repeated here"), (113, "exactly10!\nexactly9!\n exactly9!"), (114, "exactly9!")]
    return rows


@pytest.mark.parametrize("least_chars, least_docs", [(10, 2), (1, 3)])
def test_lines_equal_brute_force(spark, paragraphs, least_chars, least_docs):
    docs = table(spark, paragraphs)
    got = lines.drop_repeated_lines(docs, least_chars=least_chars, least_docs=least_docs, n_lines="a", n_dropped="b")
    assert got.columns == docs.columns + ["a", "b"]
    rows = got.collect()
    assert sorted([(r["doc_id"], r["a"], r["b"], r["text"] or "") for r in rows], key=str) == without_repeats(paragraphs, least_chars, least_docs)
    assert {(r["line"], r["places"], r["pos"]) for r in rows} == {("x", "y", 3)} and [r["text"] for r in rows if r["doc_id"] == 101] == [None]


def test_lines_of_nothing(spark):
    assert lines.drop_repeated_lines(table(spark, [])).collect() == []
    one = [(1, "a line of one document\na line of one document")]
    assert [r["text"] for r in lines.drop_repeated_lines(table(spark, one)).collect()] == [one[0][1]]


def test_lines_stay_native(spark, paragraphs):
    plan = lines.drop_repeated_lines(table(spark, paragraphs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- hard negatives ------------------------------------------------------------------------------------

def mined(rows, anchors, positives=5, negatives=5, percent=80):
    ok = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        ok[i] = min(ok.get(i, new), new)
    dim = max((len(v) for _, v in ok.values()), default=0)
    ids = sorted(ok)
    x = np.array([ok[i][1] + [0] * (dim - len(ok[i][1])) for i in ids], dtype=object).reshape(len(ids), dim)
    out = []
    for a in (a for a in ids if a in anchors):
        score = {i: int(s) for i, s in zip(ids, x @ x[ids.index(a)])} if dim else dict.fromkeys(ids, 0)
        order = sorted((i for i in ids if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if ok[i][0] == ok[a][0]][:positives]:
            fit = [i for i in order if ok[i][0] != ok[a][0] and percent * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:negatives])]
    return sorted(out)


SHAPE = "vec_id long, embedding array<float>, label int, leaf int, keys string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "k") for i, v, label in rows], SHAPE).repartition(4)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(scale=0.4, size=8)], int(rng.integers(3))) for i in range(1500)]
    rows += [(2000 + k, rows[0][1], k % 3) for k in range(300)]  # copies of an anchor: ties, and a leaf that cannot be split
    rows += [(2500, None, 1), (2501, rows[1][1], None), (2502, [float("nan")] * 8, 1), (2503, [None, *rows[1][1][1:]], 1), (2504, [float("inf")] * 8, 0), (None, rows[1][1], 0),
             (2600, rows[3][1][:5], 1), (2601, [], 2), (2602, [0.0] * 8, 2), (10, rows[11][1], 0), (10, rows[11][1], 0), (2700, [-x for x in rows[20][1]], 7), (2701, rows[20][1], 8)]
    return rows


@pytest.mark.parametrize("sample, gathered, blocks", [(64, 50, 0), (4096, 1 << 16, 256)])
def test_negatives_equal_brute_force(spark, cloud, monkeypatch, sample, gathered, blocks):
    """The same rows for any tree, chunk size and way of joining; copies, short, empty and opposite vectors included."""
    for name, value in (("SAMPLE", sample), ("GATHERED", gathered), ("SMALL_BLOCKS", blocks)):
        monkeypatch.setattr(gnat, name, value)
    anchors = {i for i, *_ in cloud if i is not None and (i % 20 == 0 or i >= 2600)}
    got = gnat.hard_negatives(vectors(spark, cloud), (F.col("vec_id") % 20 == 0) | (F.col("vec_id") >= 2600))
    assert sorted(map(tuple, got.collect())) == mined(cloud, anchors)


def test_negatives_broadcast_ids_and_few_blocks_only(spark, cloud, monkeypatch):
    """Windows and scores, several rows an anchor, are not sent through the driver."""
    hinted, real = [], gnat.bounded

    def noted(small, rows=None):
        hinted.append((small.columns, rows))
        return real(small, rows)
    monkeypatch.setattr(gnat, "bounded", noted)
    gnat.hard_negatives(vectors(spark, cloud), F.col("vec_id") % 20 == 0).count()
    assert hinted and all(rows == gnat.SMALL_BLOCKS or columns == ["id"] and rows == gnat.SMALL_IDS for columns, rows in hinted)


def test_negatives_skip_leaves(cloud):
    """Windows close about an anchor meet few leaves; none that holds a row of the window is left out."""
    rows = np.array([[math.floor(256 * x) for x in v] for i, v, _ in cloud[:1500]])
    tree = gnat.Tree(rows[:600])
    near = [np.full((len(p), len(p)), np.inf) for p in tree.points]
    far = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
    leaf = tree.place(rows, near, far)
    ranges = [dict(node=n, point=i, child=j, near=near[n][i, j], far=far[n][i, j]) for n in range(len(near)) for i, j in np.argwhere(near[n] <= far[n])]
    size = gnat.norms(rows)
    tree.measure(ranges, [dict(leaf=int(x), least=size[leaf == x].min(), most=size[leaf == x].max()) for x in np.unique(leaf)])
    score = gnat.products(rows[:50], rows)
    low = np.sort(score, 1)[:, -6][:, None]
    met = tree.met(rows[:50], low, np.full_like(low, 1 << 62))
    assert all(met[a, leaf[score[a] >= low[a]]].all() for a in range(50))
    assert met.sum() < 0.5 * met.size
    narrow = tree.met(rows[:50], low - 10, low)
    assert all(narrow[a, leaf[(score[a] >= low[a] - 10) & (score[a] <= low[a])]].all() for a in range(50))


def test_negatives_of_nothing(spark, cloud):
    assert gnat.hard_negatives(vectors(spark, []), F.lit(True)).collect() == []
    assert gnat.hard_negatives(vectors(spark, cloud[:5]), F.lit(False)).collect() == []
    one = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.9, 0.0], 2), (4, [0.5, 0.0], 2)]
    assert sorted(map(tuple, gnat.hard_negatives(vectors(spark, one), F.col("vec_id") == 1).collect())) == mined(one, {1}) == [(1, 2, 1, 3, 65536, 256 * 230)]


def test_negatives_query_equals_brute_force(spark):
    import os
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables are absent")
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = catalog.QUERIES["op13_hard_negatives"](spark, folder)
    assert sorted(map(tuple, got.collect())) == mined(rows, {i for i, *_ in rows if i % 100 == 0})
