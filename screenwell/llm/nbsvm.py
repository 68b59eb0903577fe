"""Quality classifier: naive Bayes support vectors (after Wang and Manning 2012).

Indicators of hashed word one- and two-grams are scaled by class log-count ratios, counted over every labelled training row;
a linear hinge-loss model over them is fitted by dual coordinate descent (Hsieh et al. 2008) on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

BITS = 18
BLOCK = 1 << 10


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per slot, ratio and hinge weight multiplied
    bias: float
    slope: float
    shift: float


def shape(word: bytes) -> bytes:
    """What a word looks like: letters, digits and marks, runs shortened."""
    return word.translate(_SHAPES)[:1] + bytes([min(len(word), 12)]) + word.translate(_SHAPES)[-3:]


_SHAPES = bytes(65 if chr(b).isupper() and b < 128 else 97 if b >= 128 or chr(b).islower() else 48 if chr(b).isdigit() else b for b in range(256))


def slots(text: bytes | None) -> np.ndarray:
    """Sorted distinct hash slots of the one- and two-grams of words and of word shapes, case kept."""
    items = text.split() if text else []
    if not items:
        return np.empty(0, np.int64)
    words, shapes = K.hash_all(items), K.mixed(K.hash_all(list(map(shape, items))))
    grams = np.concatenate([words, K.windows(words, 2), shapes, K.windows(shapes, 2)])
    return np.unique(grams & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _count_slots(batches):
    counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(K.raw(batch.column(0)), batch.column(1).to_pylist()):
            counts[label, slots(text)] += 1
            rows[label] += 1
    both = counts.reshape(2, -1, BLOCK)
    blocks = [(k, np.ascontiguousarray(both[:, k]).tobytes()) for k in range(both.shape[1]) if both[:, k].any()] + [(-1, rows.tobytes())]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["block", "counts"])


def _sum_blocks(batches):
    sums = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data, np.int64)
            sums[k] = sums[k] + part if k in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])


def log_ratios(labelled: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of every slot over all rows (text, label in 0 and 1); the table sent to the driver has a fixed size."""
    blocks = labelled.select("text", "label").mapInArrow(_count_slots, "block int, counts binary").repartition("block").mapInArrow(
        _sum_blocks, "block int, counts binary")
    counts = np.zeros((2, (1 << BITS) // BLOCK, BLOCK), np.int64)
    for r in blocks.filter("block >= 0").collect():
        counts[:, r["block"]] = np.frombuffer(r["counts"], np.int64).reshape(2, BLOCK)
    p, q = (counts[k].reshape(-1) + smooth for k in (1, 0))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[counts.sum(axis=0).reshape(-1) == 0] = 0
    return ratio


def hinge(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; row k has values[rows[k]] scaled to length one, and a bias term."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    data = [(r, values[r] / max(np.linalg.norm(values[r]), 1e-12)) for r in rows]
    weight = np.where(y > 0, (y < 0).sum(), (y > 0).sum()) * 2.0 / len(y)  # the rarer class weighs more
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in order.permutation(len(rows)):
            r, x = data[k]
            slope = y[k] * (w[r] @ x + bias) - 1
            new = min(max(alpha[k] - slope / (1.0 + x @ x), 0.0), cost * weight[k])
            step = (new - alpha[k]) * y[k]
            if step:
                w[r] += step * x
                bias += step
                alpha[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton steps with a little regularisation."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - y) * margins).sum() + 1e-2 * (a - 1), (p - y).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-2, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a, b


def _slots_of(batches):
    for batch in batches:
        rows = [slots(t).tolist() for t in K.raw(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], ["id", "label", "slots"])


def _drawn(want: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (id, label), those of the smallest hashes of their ids."""
    n = want.count()
    if n <= most:
        return want
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < min(1 << 30, (1 << 30) * 3 * most // (2 * n) + (1 << 20))
    return want.filter(part).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", ident: str = "doc_id", text: str = "text", most_labelled: int = 8_000,
        most_counted: int = 500_000, cost: float = 1.0, epochs: int = 20) -> Model:
    """The model of `label` = 1. Ratios count at most `most_counted` labelled rows, the hinge fit takes at most `most_labelled`, drawn
    by hashes of the id; the drawn ids go to the texts by broadcast, so no other text is moved. An id with both labels counts as 0;
    of texts that share an id the smallest is fitted. Without both classes the model scores 0.5."""
    want = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(ident).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("label")).filter("id is not null")
    texts = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    ratios = log_ratios(texts.join(F.broadcast(_drawn(want, most_counted)), "id"))
    some = texts.join(F.broadcast(_drawn(want, most_labelled)), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = some.select("id", "text", "label").mapInArrow(_slots_of, "id long, label int, slots array<int>").toArrow().sort_by("id")
    y = np.array(found["label"].to_pylist()) * 2.0 - 1
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 0.0)
    flat, ends = found["slots"].combine_chunks(), None
    ends, flat = flat.offsets.to_numpy(), flat.values.to_numpy()
    sets = [flat[a:b] for a, b in zip(ends, ends[1:])]
    # Three folds, each fitted without its rows: the calibration sees margins as they are on unknown texts.
    fold, margins = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        own = [s for s, f in zip(sets, fold) if f != k]
        if len(set(y[fold != k].tolist())) == 2:
            w, bias = hinge(own, ratios, y[fold != k], cost, max(3, epochs // 4))
            for i in np.flatnonzero(fold == k):
                margins[i] = margin(sets[i], w * ratios, ratios, bias)
    slope, shift = calibrate(margins, (y > 0).astype(float))
    w, bias = hinge(sets, ratios, y, cost, epochs)
    return Model(np.stack([w * ratios, ratios * ratios]).astype(np.float64), bias, slope, shift)


def margin(row: np.ndarray, weights: np.ndarray, ratios: np.ndarray, bias: float) -> float:
    return float(weights[row].sum() / max(np.sqrt((ratios[row] ** 2).sum()), 1e-12) + bias)


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, text in enumerate(K.raw(batch.column(1))):
                row = slots(text)
                if m.weights.ndim == 2:
                    part = m.weights[:, row].sum(axis=1)
                    raw = part[0] / max(np.sqrt(part[1]), 1e-12) + m.bias
                else:
                    raw = 0.0
                out[i] = 1 / (1 + np.exp(-np.clip(m.slope * raw + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])
    return run


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, `score` (0 to 1) and `predicted` (1 from 0.5 on).

    Null, empty and blank texts have no gram and get the score of the bias alone. Ids may be null or repeat; further columns are
    ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers per slot
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_score(shared), "id long, score double")
    return out.select(F.col("id").alias(ident), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
