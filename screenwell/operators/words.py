"""Similarity of sets of at most 64 members, each one 64-bit word; exact, over all pairs, with nothing but the words written.

At a similarity near one half two words may differ in a third of their bits, so lists of shared members let most pairs through and
writing those candidates costs far more than comparing them. Here every pair of parts is a task that compares words by two bit
counts, or blocks of them by a product of matrices of their bits; only what is similar leaves it. The number of comparisons is quadratic,
memory and written data are linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import as_list, materialise, shuffle_partitions, sort_names
from .ordering import number_rows
from .windows import dedup_first

_EPS = 1e-9
# Rows of a round of the leader walk: the first round's, and the most one task ever walks.
FIRST_BLOCK, LARGEST_BLOCK = 4096, 32768
# Most parts of a side; a pair of parts is a task.
_PARTS = 32
# Most words of a part, and the block of them compared at once, where words meet among themselves.
PART, BLOCK = 1 << 14, (512, 2048)


def _alike(a: str, b: str, t: float) -> Column:
    x, y = F.col(a), F.col(b)
    return F.bit_count(x.bitwiseAND(y)) >= F.bit_count(x.bitwiseOR(y)) * t - _EPS


def _parts(rows: DataFrame) -> DataFrame:
    return materialise(rows.repartition(min(_PARTS, shuffle_partitions(rows.sparkSession)), rows.columns[0]))


def similar_pairs(df: DataFrame, ident: str, word: str, t: float) -> DataFrame:
    """Pairs (id_a < id_b) of distinct non-empty words with Tanimoto >= t, each word under its smallest id."""
    spark, kind = df.sparkSession, df.schema[ident].dataType.simpleString()
    one = materialise(df.filter(F.col(word) != 0).groupBy(F.col(word).cast("long").alias("w")).agg(F.min(ident).alias("id")).select("id", "w"))
    n = one.count()
    parts = max(-(-n // PART), min(8, -(-n // 1024)), 1)
    tasks = min(parts * (parts + 1) // 2, max(4 * spark.sparkContext.defaultParallelism, 64))
    met = one.withColumn("own", F.pmod(F.xxhash64("w"), F.lit(parts))).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = met.select((F.least("own", "with") * parts + F.greatest("own", "with")).alias("p"), (F.col("own") <= F.col("with")).alias("left"),
                     (F.col("own") == F.col("with")).alias("itself"), "id", "w")
    found = met.repartition(tasks, "p").groupBy("p").applyInArrow(_near(t), f"a {kind}, b {kind}, similarity double")
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity").filter("id_a < id_b")


def _near(t: float):
    """Similar words of a pair of parts, or of one part among themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        left, itself = rows.column("left").to_numpy(), rows.column("itself")[0].as_py()
        sides = []
        for own in (left, left if itself else ~left):
            part = rows.filter(pa.array(own))
            words = part.column("w").to_numpy().view(np.uint64)
            sides.append((part.column("id").combine_chunks(), np.bitwise_count(words).astype(np.int64),
                          np.unpackbits(words.view(np.uint8).reshape(len(words), 8), axis=1).astype(np.float32)))
        (ids, n, bits), (others, m, more) = sides
        for i in range(0, len(n), BLOCK[0]):
            e = min(i + BLOCK[0], len(n))
            for j in range(i if itself else 0, len(m), BLOCK[1]):
                f = min(j + BLOCK[1], len(m))
                both = bits[i:e] @ more[j:f].T  # whole numbers
                # |x & y| * (1 + t) >= t * (|x| + |y|), with room for the rounding of these bounds; then exactly.
                low, high = ((z * (t / (1 + t))).astype(np.float32) for z in (n[i:e], m[j:f]))
                at = np.flatnonzero(both - low[:, None] >= high - np.float32(1e-3))
                x, y = at // (f - j), at % (f - j)
                shared = both.ravel()[at].astype(np.int64)
                union = n[i + x] + m[j + y] - shared
                ok = shared >= union * t - _EPS
                if itself:
                    ok &= j + y > i + x
                if ok.any():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + x[ok])), others.take(pa.array(j + y[ok])), pa.array(shared[ok] / union[ok])],
                                                     ["a", "b", "similarity"])
    return run


def novel(df: DataFrame, memory: DataFrame, ident: str, word: str, t: float = 0.65) -> DataFrame:
    """Rows below Tanimoto t to every word of `memory`; empty words are invalid and dropped."""
    rows = df.filter(F.col(word) != 0)
    mine = _parts(rows.select(F.col(word).alias("__wa")).distinct())
    theirs = _parts(memory.filter(F.col(word) != 0).select(F.col(word).alias("__wb")).distinct())
    # A task sends a word once, however many words of the memory it resembles.
    close = materialise(mine.join(theirs, _alike("__wa", "__wb", t)).select("__wa").distinct())
    return rows.join(close, F.col(word) == F.col("__wa"), "left_anti")


def leader_filter(df: DataFrame, ident: str, word: str, order, t: float = 0.85, *, block: int | None = None, **how) -> DataFrame:
    """Walk rows in `order`; keep a row unless its word resembles (>= t) one kept before. Rows without a word stay.

    A round walks the best undecided rows, a bounded block, in one task; every other row that resembles a kept one goes. Few kept
    words resemble nearly all others, so few rounds are needed; if all are kept, there are as many as blocks.
    """
    block, most = block or FIRST_BLOCK, max(block or 0, LARGEST_BLOCK)
    names = list(dict.fromkeys([ident, *sort_names(order)]))
    whole = df.select(*names, F.col(word).alias("__w"))
    bare = whole.filter(F.col("__w").isNull() | (F.col("__w") == 0)).select(ident)
    sets = dedup_first(whole.filter(F.col("__w") != 0), ["__w"], order)
    sets = materialise(number_rows(sets, as_list(order), (), "__a", **how).select(ident, "__a", "__w"))
    live, kept = sets.select("__a", "__w"), []
    while True:
        head = materialise(live.orderBy("__a").limit(block))
        last = head.agg(F.max("__a")).first()[0]
        if last is None:
            break
        found = materialise(head.coalesce(1).sortWithinPartitions("__a").mapInArrow(_walk(t), "__a long, __k long"))
        kept.append(found.select("__a"))
        live = materialise(live.filter(F.col("__a") > last).join(F.broadcast(found.select("__k")), _alike("__w", "__k", t), "left_anti"))
        block = min(2 * block, most)
    stay = bare
    for part in kept:
        stay = stay.unionAll(sets.join(part, "__a", "left_semi").select(ident))
    return df.join(stay, ident, "left_semi")


def _walk(t: float):
    def run(batches):
        rows = pa.Table.from_batches(batches)
        at, words = (rows.column(i).to_numpy() for i in (0, 1))
        words = words.astype(np.int64).view(np.uint64)
        kept = []
        left = np.arange(len(words))
        while len(left):
            first, left = left[0], left[1:]
            kept.append(first)
            w, rest = words[first], words[left]
            left = left[np.bitwise_count(rest & w) < np.bitwise_count(rest | w) * t - _EPS]
        yield pa.RecordBatch.from_arrays([pa.array(at[kept]), pa.array(words[kept].view(np.int64))], ["__a", "__k"])
    return run


def filter_novel(df: DataFrame, memory: DataFrame, ident: str, word: str, order, t: float = 0.65, **how) -> DataFrame:
    """Rows unlike the memory and, in arrival order, unlike each other; empty words are invalid and dropped."""
    return leader_filter(novel(df, memory, ident, word, t), ident, word, order, t, **how)
