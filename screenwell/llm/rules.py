"""Quality rules as a learned decision list: sequential covering over text statistics (after Cohen 1995).

Conjunctions of thresholds are grown on two thirds of the labelled statistics, pruned on the rest, and emitted as one ordered
Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct", "n_ends")
# Each feature is a ratio of two counts.
FEATURES = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
            "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_words"), "marks": ("n_marks", "n_words"),
            "distinct": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines"), "ends": ("n_ends", "n_words")}


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text; all zero for a null one."""
    text = text or b""
    items = text.split()
    n = len(items)
    bare = text.translate(None, K.WHITE)
    lines = [x for x in text.split(b"\n") if x.strip(K.WHITE)]
    hashes = K.hash_all(items)
    threes, repeated = K.windows(hashes, 3), np.zeros(n, bool)
    if len(threes):
        _, at, often = np.unique(threes, return_inverse=True, return_counts=True)
        hit = often[at] > 1
        for j in range(3):
            repeated[j:j + len(hit)] |= hit
    return (n, len(bare.decode("utf-8", "replace")), len(bare) - len(bare.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            int(repeated.sum()), len(lines), sum(map(bytes.isupper, items)), text.count(b"!") + text.count(b"?"), len(np.unique(hashes)),
            text.count(b"."))


def _count(batches):
    for batch in batches:
        columns = zip(*map(counts_of, K.raw(batch.column(1)))) if batch.num_rows else [[] for _ in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["id", *COUNTS])


def text_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and the COUNTS of every whole text; a null text counts as empty."""
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_count, "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def feature(name: str) -> Column:
    above, below = FEATURES[name]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.bound if self.above else x <= self.bound

    def column(self) -> Column:
        return feature(self.feature) >= self.bound if self.above else feature(self.feature) <= self.bound


Rule = tuple[Condition, ...]


def _covered(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.mask(table)
    return out


def _grow(table, bad, quantiles: int, longest: int) -> Rule:
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = None
        for name in FEATURES:
            bounds = np.unique(np.quantile(table[name][inside], np.linspace(0, 1, quantiles)))
            for bound in bounds.tolist():
                for above in (True, False):
                    c = Condition(name, above, bound)
                    now = inside & c.mask(table)
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p and p + n < p0 + n0:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if best is None or gain > best[0]:
                            best = gain, c, now
        if best is None or best[0] <= 0:
            break
        rule, inside = (*rule, best[1]), best[2]
    return rule


def _prune(rule: Rule, table, bad) -> Rule:
    def worth(r):
        now = _covered(r, table, len(bad))
        p, n = (now & bad).sum(), (now & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(table: dict[str, np.ndarray], bad: np.ndarray, quantiles: int = 33, longest: int = 4, precision: float = 0.95,
          least: int = 4, most_rules: int = 16) -> list[Rule]:
    """Ordered rules that describe the bad rows. A rule must keep `precision` on the pruning rows that earlier rules left, so a
    kind of text that good rows share is never rejected; a rule that fails is left out and its bad rows are set aside."""
    part = np.arange(len(bad)) % 3 == 2
    grow = ({k: v[~part] for k, v in table.items()}, bad[~part])
    prune = ({k: v[part] for k, v in table.items()}, bad[part])
    rules: list[Rule] = []
    for _ in range(2 * most_rules):
        if len(rules) == most_rules or grow[1].sum() < least:
            break
        rule = _grow(*grow, quantiles, longest)
        if not rule:
            break
        rule = _prune(rule, *prune)
        taken = [_covered(rule, t, len(b)) for t, b in (grow, prune)]
        hits, all_ = sum((m & b).sum() for m, (_, b) in zip(taken, (grow, prune))), sum(m.sum() for m in taken)
        held = (taken[1] & prune[1]).sum() / taken[1].sum() if taken[1].any() else 1.0
        if hits >= least and hits / all_ >= precision and held >= precision:
            rules.append(rule)
        else:
            taken = [m & b for m, (_, b) in zip(taken, (grow, prune))]
        grow, prune = (({k: v[~m] for k, v in t.items()}, b[~m]) for m, (t, b) in zip(taken, (grow, prune)))
    return rules


def labelled_counts(docs: DataFrame, labels: DataFrame, label: str, most: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and label of at most `most` labelled ids, drawn by the hash of the id."""
    drawn = (labels.filter(F.col(label).isNotNull() & F.col(ident).isNotNull())
             .select(F.col(ident).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
             .dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    some = rows.join(F.broadcast(drawn), rows["doc_id"] == drawn["id"], "left_semi")  # at most `most` rows of two numbers
    return text_counts(some).dropDuplicates(["id"]).join(F.broadcast(drawn), "id")


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", bad: int = 0, most_labelled: int = 20_000) -> list[Rule]:
    """The decision list for `label` = `bad`, fitted on those of at most `most_labelled` labelled documents that pass
    the base; without labels, no rule."""
    names = list(FEATURES)
    rows = labelled_counts(docs, labels, label, most_labelled).filter(~base_failed()).orderBy(F.xxhash64("id"), "id")
    found = rows.select("label", *[feature(k).alias(k) for k in names]).toPandas()
    if found.empty:
        return []
    return learn({k: found[k].to_numpy(float) for k in names}, (found["label"] == bad).to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: false at the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, F.lit(False)).otherwise(out)
    return out


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>=' if c.above else '<='} {c.bound:g}" for c in rule) for rule in rules]


def judge(docs: DataFrame, rules: list[Rule], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, COUNTS, `base_failed` and `kept`.

    A text fails the base if it has under 50 words or more than half of its words lie in repeated three-word windows; otherwise
    the list decides. Null, empty and blank texts fail; a null id stays null; repeated rows are judged alike; further
    columns are ignored; an empty table gives an empty result.
    """
    out = text_counts(docs, ident, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumnRenamed("id", ident)


def keep_good(docs: DataFrame, rules: list[Rule], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with all their columns, in one pass without a shuffle."""
    fields = docs.schema

    def run(batches):
        at = fields.names.index(text)
        for batch in batches:
            counts = [counts_of(t) for t in K.raw(batch.column(at))]
            table = dict(zip(COUNTS, np.array(counts, float).reshape(-1, len(COUNTS)).T))
            ratio = {k: np.divide(table[a], table[b], out=np.zeros(len(counts)), where=table[b] > 0) for k, (a, b) in FEATURES.items()}
            good = (table["n_words"] >= 50) & (100 * table["n_repeat_words"] <= 50 * table["n_words"])
            for rule in rules:
                good &= ~_covered(rule, ratio, len(counts))
            yield batch.filter(pa.array(good))
    return docs.mapInArrow(run, fields)
