"""Gradient-boosted regression trees of many targets at once, from histograms of binned features.

A target whose rows fit a task is boosted there, all targets and folds in one grouped job. A larger one is grown level by
level: tasks sum histograms of their rows, the sums meet per model, and the rows are rewritten after each tree. Residuals are
whole multiples of a unit, so sums do not depend on the order of rows, and both ways give the same trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import fresh_dir
from .windows import top_per_key

# Bins of a feature; rows of a target, the smallest hashes of its keys, whose values are cut points.
BINS, EDGE_ROWS = 64, 2000
# Cells (rows * features) of a target that one task holds, and rows of a chunk of a larger one.
LOCAL_CELLS, CHUNK_ROWS = 10_000_000, 1 << 15
# Cells of rows that are summed into a histogram at a time.
BLOCK_CELLS = 1 << 19
# A residual is a multiple of 2^-UNIT_BITS of the largest label; a split must gain this much a row, in squared units.
UNIT_BITS, LEAST_GAIN = 30, 4096.0
FINAL = -1
TREE = "tree int, node int, feature int, cut double, value double"
_ODD, _EVEN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)


def cut_points(sample: np.ndarray) -> list[np.ndarray]:
    """Per feature the values at which it may be split: all but the last, or quantiles if there are many."""
    out = []
    for column in sample.T:
        values = np.unique(column[~np.isnan(column)])
        if len(values) > BINS:
            values = np.unique(np.quantile(column[~np.isnan(column)], np.arange(1, BINS) / BINS, method="inverted_cdf"))
        else:
            values = values[:-1]
        out.append(values)
    return out


def codes_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of every value; a value lies left of cut b if its bin is at most b."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j])
    return out


def first_bins(cuts: list[np.ndarray]) -> np.ndarray:
    """Where each feature's bins begin among all bins."""
    return np.cumsum([0, *(len(c) + 1 for c in cuts)])


def unit_of(y: np.ndarray | float) -> float:
    top = float(np.max(np.abs(y), initial=0.0))
    return float(2.0 ** (np.ceil(np.log2(top)) - UNIT_BITS)) if top > 0 else 1.0


def drawn(hashes: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree is fitted on."""
    h = (hashes.view(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B1 + seed)) * _ODD
    h = (h ^ (h >> _MIX)) * _EVEN
    return (h >> np.uint64(40)).astype(float) < share * 2.0 ** 24


def histogram(codes: np.ndarray, starts: np.ndarray, place: np.ndarray, residual: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of residuals by (node, bin), added up over blocks of rows, since a cell takes 16 bytes here and 1 in `codes`."""
    bins, step = int(starts[-1]), max(1, BLOCK_CELLS // max(1, codes.shape[1]))
    n, s = np.zeros(nodes * bins, np.int64), np.zeros(nodes * bins, np.int64)
    for low in range(0, len(codes), step):
        part, own = codes[low:low + step], residual[low:low + step]
        at = (part + starts[:-1] + place[low:low + step, None] * bins).ravel()
        n += np.bincount(at, minlength=nodes * bins)
        total = np.bincount(at, np.repeat(own.astype(float), part.shape[1]), minlength=nodes * bins)  # whole numbers below 2^53
        s += np.rint(total).astype(np.int64)
    return n.reshape(nodes, bins), s.reshape(nodes, bins)


def best_splits(n: np.ndarray, s: np.ndarray, starts: np.ndarray) -> list[tuple]:
    """Per node (feature, bin, rows left, sum left, rows right, sum right); an unsplit node sends all rows left."""
    ends = starts[1:] - 1
    first = starts[:-1].repeat(np.diff(starts))
    out = []
    for counts, sums in zip(n, s):
        total_n, total_s = int(counts[:starts[1]].sum()), int(sums[:starts[1]].sum())
        c, z = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sums)])
        left_n, left_s = c[1:] - c[first], z[1:] - z[first]
        right_n, right_s = total_n - left_n, total_s - left_s
        ok = (left_n > 0) & (right_n > 0)
        ok[ends] = False
        gain = np.full(len(counts), -np.inf)
        gain[ok] = left_s[ok].astype(float) ** 2 / left_n[ok] + right_s[ok].astype(float) ** 2 / right_n[ok]
        b = int(gain.argmax()) if len(gain) else 0
        if total_n and gain[b] - float(total_s) ** 2 / total_n > LEAST_GAIN * total_n:
            j = int(np.searchsorted(starts, b, side="right")) - 1
            out.append((j, b - int(starts[j]), int(left_n[b]), int(left_s[b]), int(right_n[b]), int(right_s[b])))
        else:
            out.append((0, 255, total_n, total_s, 0, 0))
    return out


def below(codes: np.ndarray, levels: list[list[tuple]]) -> np.ndarray:
    """The place of every row among the nodes under the levels grown so far."""
    place = np.zeros(len(codes), np.int64)
    for splits in levels:
        feature, cut = (np.array([s[k] for s in splits]) for k in (0, 1))
        place = 2 * place + (codes[np.arange(len(codes)), feature[place]] > cut[place])
    return place


def steps_of(levels: list[list[tuple]], rate: float, unit: float) -> np.ndarray:
    """What each leaf adds to a prediction."""
    ends = [(n, s) for x in levels[-1] for n, s in ((x[2], x[3]), (x[4], x[5]))]
    return np.array([rate * (s * unit / n) if n else 0.0 for n, s in ends])


def tree_rows(tree: int, levels: list[list[tuple]], steps: np.ndarray, cuts: list[np.ndarray]) -> list[tuple]:
    """A tree as rows of `TREE`: nodes are numbered as in a heap."""
    inner = [x for splits in levels for x in splits]
    rows = [(tree, i, x[0], float(cuts[x[0]][x[1]]) if x[1] < 255 else float("inf"), None) for i, x in enumerate(inner)]
    return rows + [(tree, len(inner) + i, None, None, float(v)) for i, v in enumerate(steps)]


def r2_of(y: np.ndarray, predicted: np.ndarray) -> tuple[int, float, float, float]:
    """(rows, sum, sum of squares, sum of squared errors)."""
    return len(y), float(y.sum()), float((y ** 2).sum()), float(((y - predicted) ** 2).sum())


def used_folds(rows: int, folds: int) -> int:
    return min(folds, max(2, rows // 10))


def boost(codes, cuts, y, hashes, train, settings) -> tuple[float, list, np.ndarray]:
    """(base, trees, predictions of all rows): `trees` are rows of `TREE`, fitted on the rows `train`."""
    starts, unit = first_bins(cuts), unit_of(y)
    base = float(np.rint(y[train] / unit).astype(np.int64).sum()) * unit / max(1, int(train.sum()))
    now, out = np.full(len(y), base), []
    for tree in range(settings["maxIter"]):
        residual = np.rint((y - now) / unit).astype(np.int64)
        use, levels = train & drawn(hashes, tree, settings["subsamplingRate"], settings["seed"]), []
        own, left = codes[use], residual[use]
        for level in range(settings["maxDepth"]):
            levels.append(best_splits(*histogram(own, starts, below(own, levels), left, 1 << level), starts))
        steps = steps_of(levels, settings["stepSize"], unit)
        now = now + steps[below(codes, levels)]
        out += tree_rows(tree, levels, steps, cuts)
    return base, out, now


def _base_row(base: float, settings) -> tuple:
    return (-1, 0, settings["maxDepth"], None, base)


_FIT = TREE + ", fold int, rows long, total double, squares double, errors double"


def _local(target: str, folds: int, settings: dict):
    """One model of a target from all its rows: the trees of the final one, the errors of one fold of the others."""
    def run(key: tuple, group: pa.Table) -> pa.Table:
        fold, y, hashes = key[1].as_py(), group["__y"].to_numpy(), group["__h"].to_numpy()
        order = np.lexsort((y, hashes))  # the same rows are cut points whatever their order
        y, hashes = y[order], hashes[order]
        mine = hashes % used_folds(len(y), folds)
        test, rows = mine == fold, []
        if fold == FINAL or test.any() and not test.all():
            cuts, codes = _coded(group["__x"], order)
            base, trees, predicted = boost(codes, cuts, y, hashes, ~test, settings)
            rows = [t + (None,) * 5 for t in [_base_row(base, settings), *trees]] if fold == FINAL else [(None,) * 5 + (fold, *r2_of(y[test], predicted[test]))]
        out = pa.Table.from_batches([_batch(rows, _FIT)])
        return out.add_column(0, target, pa.array([key[0].as_py()] * len(rows), key[0].type))
    return run


def _coded(x: pa.ChunkedArray, order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(cut points, bins) of the rows of `x` put into `order`; one chunk at a time is a matrix of numbers."""
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in x.chunks if len(c)]  # views of the chunks
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError("the rows of a target have different numbers of features")
    ends = np.cumsum([len(p) for p in parts])
    sample = np.stack([parts[k][i - ends[k]] for i in order[:EDGE_ROWS] for k in [np.searchsorted(ends, i, side="right")]])
    cuts = cut_points(sample)
    return cuts, np.concatenate([codes_of(p, cuts) for p in parts])[order]


def fit_local(rows: DataFrame, target: str, models: list[int], folds: int, settings: dict) -> DataFrame:
    """Rows (target, __h, __y, __x) of targets that fit a task; every model of every target is a group of its own."""
    each = rows.withColumn("__fold", F.explode(F.array(*[F.lit(m) for m in models])))
    kind = rows.schema[target].dataType.simpleString()
    return each.groupBy(target, "__fold").applyInArrow(_local(target, folds, settings), f"{target} {kind}, {_FIT}")


_CHUNK = "t int, hashes binary, y binary, fold binary, codes binary, now binary"


def _chunks(info: dict, models: list[int]):
    """Rows (t, __h, __y, __x) as chunks with the predictions of all models so far."""
    def run(batches):
        for batch in batches:
            t, h, y = (batch.column(k).to_numpy() for k in range(3))
            out = []
            for k in np.unique(t):
                at = np.flatnonzero(t == k)
                cuts, bases, folds = info[int(k)]["cuts"], info[int(k)]["bases"], info[int(k)]["folds"]
                x = batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                now = np.repeat(np.array(bases)[:, None], len(at), 1)
                out.append((int(k), h[at].tobytes(), y[at].tobytes(), (h[at] % folds).astype(np.int8).tobytes(), codes_of(x, cuts).tobytes(), now.tobytes()))
            yield _batch(out, _CHUNK)
    return run


def _batch(rows, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _opened(batch, info, models):
    """The chunks of a batch, one after the other: a batch may hold all chunks of a task."""
    for i in range(batch.num_rows):
        h, y, fold, codes, now = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in enumerate((np.int64, float, np.int8, np.uint8, float), 1))
        yield batch.column(0)[i].as_py(), h, y, fold, codes.reshape(len(h), -1), now.reshape(len(models), -1)


def _sums(info, models, levels, tree, settings):
    """The histograms of this task's rows for the next level of every model."""
    def run(batches):
        held = {}
        for batch in batches:
            for t, h, y, fold, codes, now in _opened(batch, info, models):
                use = drawn(h, tree, settings["subsamplingRate"], settings["seed"])
                for i, m in enumerate(models):
                    own = use & (fold != m)
                    residual = np.rint((y[own] - now[i][own]) / info[t]["unit"]).astype(np.int64)
                    got = histogram(codes[own], first_bins(info[t]["cuts"]), below(codes[own], levels[t, m]), residual, 1 << len(levels[t, m]))
                    held[t, m] = [a + b for a, b in zip(held[t, m], got)] if (t, m) in held else list(got)
        yield _batch([(t, m, n.astype(np.int64).tobytes(), s.tobytes()) for (t, m), (n, s) in held.items()], "t int, m int, n binary, s binary")
    return run


def _choose(info, depth):
    """Sum the histograms of each model, which meet in one task, and split its nodes."""
    def run(batches):
        held = {}
        for batch in batches:
            for t, m, *got in zip(*(batch.column(k).to_pylist() for k in range(4))):
                got = [np.frombuffer(x, np.int64) for x in got]
                held[t, m] = [a + b for a, b in zip(held[t, m], got)] if (t, m) in held else got
        rows = [(t, m, i, *x) for (t, m), got in held.items()
                for i, x in enumerate(best_splits(*(a.reshape(1 << depth, -1) for a in got), first_bins(info[t]["cuts"])))]
        yield _batch(rows, _SPLIT)
    return run


_SPLIT = "t int, m int, place int, feature int, bin int, n_left long, s_left long, n_right long, s_right long"


def _advance(info, models, levels, steps):
    """The chunks with the tree just grown added to their predictions."""
    def run(batches):
        for batch in batches:
            for t, h, y, fold, codes, now in _opened(batch, info, models):
                now = np.stack([now[i] + steps[t, m][below(codes, levels[t, m])] for i, m in enumerate(models)])
                yield _batch([(t, *(x.tobytes() for x in (h, y, fold, codes, now)))], _CHUNK)
    return run


def _errors(info, models):
    def run(batches):
        for batch in batches:
            yield _batch([(t, m, *r2_of(y[fold == m], now[i][fold == m])) for t, h, y, fold, codes, now in _opened(batch, info, models)
                          for i, m in enumerate(models) if m != FINAL and (fold == m).any()], "t int, m int, rows long, total double, squares double, errors double")
    return run


def _written(df: DataFrame) -> DataFrame:
    path = fresh_dir(df.sparkSession, "boosting")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_large(rows: DataFrame, target: str, targets: list, models: list[int], folds: int, settings: dict) -> DataFrame:
    """As `fit_local`, for the few targets that are larger than a task: their number is at most all cells / LOCAL_CELLS."""
    spark = rows.sparkSession
    listed = spark.createDataFrame(list(enumerate(targets)), f"__no int, {target} {rows.schema[target].dataType.simpleString()}")
    rows = rows.join(F.broadcast(listed), target).select(F.col("__no").alias("t"), "__h", "__y", "__x")
    unit = {r["t"]: unit_of(r["top"]) for r in rows.groupBy("t").agg(F.max(F.abs("__y")).alias("top")).collect()}
    whole = F.round(F.col("__y") / F.element_at(F.create_map(*[F.lit(x) for p in unit.items() for x in p]), F.col("t"))).cast("decimal(38,0)")
    size = {r["t"]: r["n"] for r in rows.groupBy("t").count().withColumnRenamed("count", "n").collect()}
    n_folds = {t: used_folds(n, folds) for t, n in size.items()}
    fold = F.pmod(F.col("__h"), F.element_at(F.create_map(*[F.lit(x) for p in n_folds.items() for x in p]), F.col("t")))
    sums = {(r["t"], r["f"]): (r["n"], int(r["s"])) for r in rows.groupBy("t", fold.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("s")).collect()}
    sample = top_per_key(rows, ["t"], ["__h", "__y"], EDGE_ROWS).select("t", "__x").collect()
    info = {}
    for t in size:
        cuts = cut_points(np.array([r["__x"] for r in sample if r["t"] == t]))
        per = {m: [v for (k, f), v in sums.items() if k == t and f != m] for m in models}
        bases = [sum(s for _, s in per[m]) * unit[t] / max(1, sum(n for n, _ in per[m])) for m in models]
        info[t] = dict(cuts=cuts, unit=unit[t], folds=n_folds[t], bases=bases)
    trees = [(t, *_base_row(info[t]["bases"][models.index(FINAL)], settings)) for t in size if FINAL in models]
    chunks = _written(rows.mapInArrow(_chunks(info, models), _CHUNK))
    for tree in range(settings["maxIter"]):
        levels = {(t, m): [] for t in size for m in models}
        for depth in range(settings["maxDepth"]):
            summed = chunks.mapInArrow(_sums(info, models, levels, tree, settings), "t int, m int, n binary, s binary").repartition("t", "m")
            found = {(r["t"], r["m"], r["place"]): tuple(r)[3:] for r in summed.mapInArrow(_choose(info, depth), _SPLIT).collect()}
            for t, m in levels:
                levels[t, m] = levels[t, m] + [[found[t, m, i] for i in range(1 << depth)]]
        steps = {(t, m): steps_of(levels[t, m], settings["stepSize"], info[t]["unit"]) for t, m in levels}
        trees += [(t, *r) for t in size if FINAL in models for r in tree_rows(tree, levels[t, FINAL], steps[t, FINAL], info[t]["cuts"])]
        chunks = _written(chunks.mapInArrow(_advance(info, models, levels, steps), _CHUNK))
    errors = chunks.mapInArrow(_errors(info, models), "t int, fold int, rows long, total double, squares double, errors double")
    errors = errors.groupBy("t", "fold").agg(*[F.sum(c).alias(c) for c in ("rows", "total", "squares", "errors")])
    grown = spark.createDataFrame(trees, "t int, " + TREE).unionByName(errors, allowMissingColumns=True)
    return listed.join(grown.withColumnRenamed("t", "__no"), "__no").drop("__no")
