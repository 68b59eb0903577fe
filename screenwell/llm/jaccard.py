"""N-gram Jaccard join by the size-aware heavy-light method (after Deng, Tao and Li 2018).

Small sets enumerate the fixed-size subsets that a partner must share; large sets scan the inverted lists of their rarest
shingles. The boundary is the size at which a cost model, fed with the counted sizes, finds enumeration no longer cheaper.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels as K
from .shared import bounded, components, dropped, kept

SLOTS, CHUNK = 1 << 19, 1 << 10
# What a scanned list entry costs against an enumerated subset, which needs no later check.
SCAN_COST = 6
LARGEST_BOUNDARY = 24


def least_overlap(n: int, percent: int) -> int:
    """Members a set of n must share with any partner."""
    return -(-n * percent // 100)


def boundary(sizes: dict[int, int], percent: int) -> int:
    """Sets below this size are enumerated; `sizes` counts the sets of each size below LARGEST_BOUNDARY."""
    best, best_cost, cost = 1, 0, 0
    for n in range(1, LARGEST_BOUNDARY):
        low = least_overlap(n, percent)
        small, scan = sum(comb(n, s) for s in range(low, n + 1)), SCAN_COST * (n - low + 1)
        cost += sizes.get(n, 0) * (small - scan) if sizes.get(n) else small - scan
        if cost <= best_cost:
            best, best_cost = n + 1, cost
    return best


def _sign(words: int):
    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), K.raw(batch.column(1))):
                members = K.shingles(text, words)
                np.add.at(seen, members & np.uint64(SLOTS - 1), 1)
                rows.append((i, len(members), K.set_key(members), *parities(members)))
            yield _table(rows, None)
        chunks = seen.reshape(-1, CHUNK)
        filled = [k for k in range(len(chunks)) if chunks[k].any()]
        for at in range(0, len(filled), 64):
            yield _table(None, [(k, chunks[k].tobytes()) for k in filled[at:at + 64]])
    return run


_SKETCH = [f"s{k}" for k in range(16)]
_SIGNED = "id long, n long, set_id long, " + "".join(f"{c} long, " for c in _SKETCH) + "chunk int, counts binary"


def parities(members: np.ndarray) -> list[int]:
    """1024 parity bits as 16 longs: bit b tells whether an odd number of members falls to it. Two sets differ in at least as
    many members as their sketches differ in bits, so a pair can be ruled out without its sets."""
    bits = np.bincount(((members >> np.uint64(20)) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _table(rows, counts):
    n = len(rows if rows is not None else counts)
    ids, sizes, keys, *sketch = (list(x) for x in zip(*rows)) if rows else ([None] * n,) * 19
    chunk, data = (list(x) for x in zip(*counts)) if counts else ([None] * n,) * 2
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()),
                                       *[pa.array(x, pa.int64()) for x in sketch], pa.array(chunk, pa.int32()), pa.array(data, pa.binary())], ["id", "n", "set_id", *_SKETCH, "chunk", "counts"])


def _sum_chunks(batches):
    sums = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data, np.int64)
            sums[k] = sums[k] + part if k in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                     ["chunk", "counts"])


def slot_counts(signed: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each hash slot. The table has a fixed size; it only orders shingles, so the shared
    slots of a large corpus cost time, never results."""
    rows = signed.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_sum_chunks, "chunk int, counts binary")
    out = np.zeros((SLOTS // CHUNK, CHUNK), np.int64)
    for r in rows.collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def _entries(words: int, percent: int, bound: int, counts):
    def run(batches):
        order, emitted = counts.value, set()
        large_from = least_overlap(bound, percent)
        for batch in batches:
            token, set_id, size, pos, small = [], [], [], [], []
            for text in K.raw(batch.column(0)):
                members = K.shingles(text, words)
                n, key = len(members), K.set_key(members)
                if not n or key in emitted:
                    continue
                emitted.add(key)
                low = least_overlap(n, percent)
                if n < bound:
                    for s, part in K.subsets(members, range(low, n + 1)):
                        token.append(np.array([part], np.int64))
                        pos.append(np.array([s]))
                        set_id.append(key), size.append(n), small.append(1)
                if n >= large_from:
                    rank = np.lexsort((members, order[members & np.uint64(SLOTS - 1)]))[:n - low + 1]
                    token.append(members[rank].view(np.int64))
                    pos.append(np.arange(len(rank)))
                    set_id.append(key), size.append(n), small.append(0)
            if not token:
                continue
            lens = [len(t) for t in token]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(token)), pa.array(np.repeat(np.array(small, np.int8), lens)),
                pa.array(np.repeat(np.array(size, np.int32), lens)), pa.array(np.repeat(np.array(set_id, np.int64), lens)),
                pa.array(np.concatenate(pos).astype(np.int32))], ["token", "small", "n", "set_id", "pos"])
    return run


def _sets(words: int):
    def run(batches):
        seen = set()
        for batch in batches:
            # A repeated row gives its set once per task.
            members = {K.set_key(m): m for m in (K.shingles(t, words) for t in K.raw(batch.column(0)))}
            members = [m for k, m in members.items() if k not in seen]
            seen.update(map(K.set_key, members))
            ends = np.cumsum([0] + [len(m) for m in members]).astype(np.int32)
            values = np.concatenate(members).view(np.int64) if members else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([K.set_key(m) for m in members], pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["set_id", "members"])
    return run


def _unlike(left: str, right: str) -> str:
    """SQL for the members that two sets surely do not share."""
    return " + ".join(f"bit_count({left}{c} ^ {right}{c})" for c in _SKETCH)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n, m) whose sketches do not rule them out."""
    for k in "ab":
        pairs = pairs.join(sets.select(F.col("set_id").alias(k), *[F.col(c).alias(k + c) for c in _SKETCH]), k)
    return pairs.filter(f"(100 + {percent}) * ({_unlike('a', 'b')}) <= (100 - {percent}) * (n + m)").select("a", "b")


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            ok = np.zeros(batch.num_rows, bool)
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                x, y = lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])
    return run


def _linked(docs: DataFrame, pairs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets really are similar enough."""
    ids = pairs.select(F.col("a").alias("set_id")).distinct().union(pairs.select("b").distinct()).distinct()
    wanted = kept(ids.join(reps, "set_id").select(F.col("rep").alias("id")), "wanted")
    texts = docs.join(bounded(wanted), "id", "left_semi").select("text")
    sets = kept(texts.mapInArrow(_sets(words), "set_id long, members array<long>"), "sets")
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("y"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")
    out = kept(found.distinct(), "links")
    dropped(wanted, sets)
    return out


def jaccard_components(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: its id, `n_shingles` and `component_id`, the smallest id it is linked with through similar sets.

    A set holds the distinct `words`-word shingles of the A-Z-folded text; fewer words make one shingle; a null, empty or
    blank text makes none and is linked with nothing. Two rows link when 100 * intersection >= percent * union. Equal sets
    (exact copies) count as one set throughout. Rows with a null id have a null component; rows that repeat an id share one.
    Other columns are ignored; an empty table gives an empty result.

    Candidates of large sets come in rounds: neighbours in each inverted list first, then only pairs of different components,
    in the longest list of each set before all lists, so that a mass of near copies is not paired with itself. Every pair that shares a prefix shingle is either
    checked or already in one component; no list is cut.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    signed = kept(docs.mapInArrow(_sign(words), _SIGNED), "signed")
    rows = signed.filter("chunk is null").select("id", "n", "set_id", *_SKETCH)
    sets = kept(rows.filter("n > 0 and id is not null").groupBy("set_id").agg(
        F.min("id").alias("rep"), *[F.max(c).alias(c) for c in _SKETCH]), "reps")
    reps = sets.select("set_id", "rep")
    sizes = {r["n"]: r["count"] for r in rows.filter(F.col("n") < LARGEST_BOUNDARY).groupBy("n").count().collect()}
    bound = boundary(sizes, percent)
    counts = spark.sparkContext.broadcast(slot_counts(signed))
    entries = docs.filter("id is not null").select("text").mapInArrow(
        _entries(words, percent, bound, counts), "token long, small byte, n int, set_id long, pos int")
    whole, by_size = Window.partitionBy("token"), Window.partitionBy("token").orderBy("n", "set_id")
    fits = (f"100 * least(n, m) >= {percent} * greatest(n, m) and (100 + {percent}) * (least(pos, q) + least(n - pos, m - q)) >= {percent} * (n + m)")
    lists = entries.repartition("token").withColumns({"lo": F.min("set_id").over(whole), "hi": F.max("set_id").over(whole)}).filter(
        "lo <> hi").drop("lo", "hi").dropDuplicates(["token", "small", "set_id"])
    # Most lists hold two sets; their one pair is judged by size and position here.
    beside = {"k": F.count(F.lit(1)).over(whole), **{f"{to}{c}": f(c).over(by_size) for to, f in (("l", F.lag), ("r", F.lead)) for c in ("n", "pos")}}
    near = [fits.replace("m", f"{x}n").replace("q", f"{x}pos") for x in "lr"]
    lists = kept(lists.withColumns(beside).filter(f"small = 1 or k > 2 or ({near[0]}) or ({near[1]})").select(
        "token", "small", "n", "set_id", "pos", "k"), "lists")

    # Small sets: all who share a subset of s members with the smallest owner link with it if the sizes allow; if the
    # smallest does not allow it, no other owner does.
    owners = lists.filter("small = 1").withColumns({"b": F.first("set_id").over(by_size), "m": F.first("n").over(by_size)})
    light = owners.filter(f"set_id <> b and 100 * pos >= {percent} * (n + m - pos)").select(F.col("set_id").alias("a"), "b")

    heavy = lists.filter("small = 0")
    chain = heavy.withColumns({to: F.lag(c).over(by_size) for to, c in (("b", "set_id"), ("m", "n"), ("q", "pos"))}).filter("b is not null").filter(fits)
    ordered = [F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")]
    chain = chain.select(*ordered, "n", "m").dropDuplicates(["a", "b"])  # n + m is all that counts
    first = kept(_possible(chain, sets, percent), "pairs")
    named = _named(light.unionByName(_linked(docs, first, reps, words, percent)), reps)
    found = components(named)

    # The pair of a list of two has been judged above. Of lists with the same sets one is enough, since a similar pair fits at
    # every shared shingle.
    labelled = heavy.filter("k > 2").join(sets, "set_id").join(found, F.col("rep") == F.col("node"), "left").select(
        "token", "set_id", "n", "pos", *_SKETCH, F.coalesce("component", "rep").alias("c"))
    spans = labelled.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("sum"),
                                          F.count(F.lit(1)).alias("k")).filter("lo <> hi").groupBy("sum", "k").agg(F.min("token").alias("token"))
    mixed = kept(labelled.join(spans.select("token", "k"), "token"), "mixed")
    # Near copies of one text meet in many lists. Taken once each, in the longest list of a set, most of them are joined; then
    # all lists are taken, which are left with the pairs of what are still different components.
    top = mixed.groupBy("set_id").agg(F.max(F.struct("k", "token")).alias("top")).select("set_id", "top.token")
    checked, spent = first, [lists, first, mixed, named]
    for share in (mixed.join(top, ["set_id", "token"]), mixed):
        part = share.join(found, F.col("c") == F.col("node"), "left").withColumn("c", F.coalesce("component", "c")).drop("node", "component")
        live = part.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
        part = kept(part.join(live, "token"), "mixed")
        other = part.select("token", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("c").alias("d"),
                            *[F.col(c).alias(f"o{c}") for c in _SKETCH])
        second = kept(part.join(other, "token").filter("c <> d and (m < n or m = n and b < set_id)").filter(
            f"{fits} and (100 + {percent}) * ({_unlike('', 'o')}) <= (100 - {percent}) * (n + m)").select(*ordered).distinct().join(
            checked, ["a", "b"], "left_anti"), "pairs")
        if second.limit(1).count():
            # Those found so far are stars already, so few rounds remain.
            stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = components(stars.unionByName(_named(_linked(docs, second, reps, words, percent), reps)))
        checked = checked.unionByName(second)
        spent.append(second)
        dropped(part)
    dropped(*spent)
    out = rows.select("id", "n", "set_id").join(reps, "set_id", "left").join(found, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))


def _named(links: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between set ids as links between the smallest document ids that hold them."""
    left = reps.select(F.col("set_id").alias("a"), F.col("rep").alias("u"))
    right = reps.select(F.col("set_id").alias("b"), F.col("rep").alias("v"))
    return kept(links.join(left, "a").join(right, "b").select(F.col("u").alias("a"), F.col("v").alias("b")), "links")


def one_per_component(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` with the smallest id of their component; rows with a null id stay, rows that repeat an id share a fate."""
    found = jaccard_components(docs, ident, text, words, percent)
    drop = kept(found.filter(F.col(ident) != F.col("component_id")).select(ident).distinct(), "drop")
    return docs.join(bounded(drop), ident, "left_anti").select(*docs.columns)
