"""Set-similarity joins and greedy diverse selection, exact and without comparing all pairs.

Two sets with Tanimoto >= t share tokens among the first |x| - ceil(t|x|) + 1 of each when tokens are
ordered rarest first, and their sizes differ by a factor of at most t (Chaudhuri et al. 2006;
Bayardo et al. 2007; Xiao et al. 2008). Equal sets are folded into one before any join, so a
mass of copies costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fingerprints import tanimoto
from ..runtime import as_list, at_most, fits_broadcast, largest_group, materialise, sort_cols, sort_names
from .joins import salted_join
from .ordering import number_rows
from .windows import dedup_first, top_per_key

_FREQUENCY_SLOTS = 1 << 16
_EPS = 1e-9
_SHARE = 0.05
# Bits of a token beside its rank in a prefix. Tokens that agree in them only add candidates.
_TOKEN_BITS = 46
# A list of sets that hold one token is cut into blocks of about so many; every pair of blocks is a key of its own.
LIST_BLOCK = 2048
# Chunks of actives whose bound is at least this part of the highest are met first.
_NEAR = 0.85


def distinct_sets(df: DataFrame, ident: str, fp: str, order) -> DataFrame:
    """One row per distinct non-empty set: its first row in `order`."""
    return dedup_first(df.filter(F.size(fp) > 0), [fp], order)


def copies(df: DataFrame, ident: str, fp: str) -> DataFrame:
    """Every row beside the smallest id that holds the same set.

    Sets meet by the SHA-256 of their elements in order: 32 bytes a row are written, the sets themselves nowhere.
    """
    rows = materialise(df.select(ident, _set_digest(fp).alias("__set"))).filter(F.col("__set").isNotNull())
    first = rows.groupBy("__set").agg(F.min(ident).alias("first_id"))
    return rows.join(first, "__set").select(ident, "first_id")


def _set_digest(fp) -> Column:
    """32 bytes that name a sorted set of numbers; null for an empty one or none."""
    listed = F.array_join(F.transform(fp, lambda x: x.cast("string")), ",")
    return F.unhex(F.sha2(F.nullif(listed, F.lit("")), 256))


def _held(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, written once, without empty sets (last column).

    The sets are read by several branches below; a filter on an unwritten set would also be pushed
    down and compute every set a second time.
    """
    return materialise(df.select(*columns)).filter(F.size(columns[-1]) > 0)


def _rarity(sides: list[DataFrame], fp: str) -> DataFrame:
    """The rank of each hash slot by its token count as a table of one row, `__rank`: at most 65 536 numbers reach the driver, and
    a rank stays small however many tokens a slot holds. As a constant it would be part of every plan the driver keeps."""
    tokens = None
    for side in sides:
        part = side.select(F.explode(fp).alias("t"))
        tokens = part if tokens is None else tokens.unionAll(part)
    slots = tokens.groupBy(F.pmod(F.col("t"), F.lit(_FREQUENCY_SLOTS)).alias("slot")).count().collect()
    table = [0] * _FREQUENCY_SLOTS
    for rank, (slot, _) in enumerate(sorted(slots, key=lambda r: (r[1], r[0])), start=1):
        table[slot] = rank
    return materialise(sides[0].sparkSession.createDataFrame([(table,)], "__rank array<bigint>").coalesce(1))


def _prefixes(sets: DataFrame, ident: str, fp: str, rarity: DataFrame, t: float) -> DataFrame:
    """(ident, n, k, token): the rarest tokens of each set, as many as similarity calls for.

    Sets with Tanimoto >= t share at least k of the first n - ceil(tn) + k tokens of each (Wang, Li
    and Feng 2012). k grows with the set, so that chance meetings are dropped before any set is read.
    """
    n = F.size(fp)
    k = F.floor(n * _SHARE).cast("int") + 1
    # Rarity in the high bits, token in the low ones: one sort of plain longs.
    ranked = F.sort_array(F.transform(fp, lambda x: F.coalesce(
        F.get("__rank", F.pmod(x, F.lit(_FREQUENCY_SLOTS))) * (1 << _TOKEN_BITS) + x.cast("long").bitwiseAND(F.lit((1 << _TOKEN_BITS) - 1)),
        F.lit(0).cast("long"))))
    keep = (n - F.ceil(n * t - _EPS)).cast("int") + k
    return sets.crossJoin(F.broadcast(rarity)).select(ident, n.alias("n"), k.alias("k"), F.explode(F.slice(ranked, F.lit(1), keep)).alias("token"))


def _sizes_allow(n: Column, m: Column, t: float) -> Column:
    return (m >= n * t - _EPS) & (n >= m * t - _EPS)


def _blocks(rows: DataFrame, ident: str, block: int) -> DataFrame:
    """(token, parts, i): tokens of more than `block` rows, and their rows' share among so many parts."""
    hot = rows.groupBy("token").count().filter(F.col("count") > block)
    return hot.select("token", F.ceil(F.col("count") / block).cast("int").alias("parts"))


def _keyed(rows: DataFrame, ident: str, parts: DataFrame | None, other: DataFrame | None, side: int, triangle: bool) -> DataFrame:
    """Rows with the block pairs (i, j) in which they meet others: j for every part of the other side, i their own, or the reverse."""
    for name, table in (("__own", parts), ("__other", other)):
        part = table.withColumnRenamed("parts", name) if table is not None else None
        rows = rows.join(F.broadcast(part) if at_most(part, 100_000) else part, "token", "left") if part is not None else rows.withColumn(name, F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64(ident), F.coalesce("__own", F.lit(1)))
    last = F.coalesce("__other", F.lit(1)) - 1
    start, end = (own if side == 0 else F.lit(0), last if side == 0 else own) if triangle else (F.lit(0), last)
    rows = rows.withColumn("__mine", own).withColumn("__with", F.explode(F.sequence(start.cast("int"), end.cast("int"))))
    i, j = ("__mine", "__with") if side == 0 else ("__with", "__mine")
    return rows.select("*", F.col(i).cast("int").alias("__i"), F.col(j).cast("int").alias("__j")).drop("__own", "__other", "__mine", "__with")


def _candidates(left: DataFrame, right: DataFrame, a: str, b: str, t: float, extra: Column | None = None, itself: bool = False,
                block: int | None = None) -> DataFrame:
    """(a, b) of compatible sizes that share enough prefix tokens; with `itself` the sides are the same rows and a < b.

    Rows that hold a token of more than `block` rows meet in pairs of blocks, so no task takes a long list whole: one of m rows
    is (m / block)^2 / 2 keys of at most 2 * block rows.
    """
    block = block or LIST_BLOCK
    r = right.select(F.col(b), F.col("n").alias("m"), F.col("k").alias("l"), "token")
    hot = materialise(_blocks(left, a, block))
    theirs = hot if itself else materialise(_blocks(r, b, block))
    on = ["token"]
    if not hot.isEmpty() or not theirs.isEmpty():
        left, r, on = _keyed(left, a, hot, theirs, 0, itself), _keyed(r, b, theirs, hot, 1, itself), ["token", "__i", "__j"]
    pairs = left.join(r, on).filter(_sizes_allow(F.col("n"), F.col("m"), t))
    if extra is not None:
        pairs = pairs.filter(extra)
    if itself and len(on) > 1:  # across blocks a pair meets once, in either order
        pairs = pairs.filter((F.col("__i") < F.col("__j")) | (F.col(a) < F.col(b)))
        pairs = pairs.withColumns({a: F.least(a, b), b: F.greatest(a, b)}).filter(F.col(a) < F.col(b))
    elif itself:
        pairs = pairs.filter(F.col(a) < F.col(b))
    # A similar pair overlaps in at least ceil(t * larger size) tokens, so no more may be asked for.
    enough = F.least("k", "l", F.ceil(F.greatest("n", "m") * t - _EPS))
    return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"), F.first(enough).alias("enough")).filter(
        "shared >= enough").select(a, b)


def _alike(a: Column, b: Column, t: float) -> Column:
    """Tanimoto >= t with the intersection evaluated once."""
    return F.size(F.array_intersect(a, b)) * (1 + t) >= (F.size(a) + F.size(b)) * t - _EPS


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, fp: str, t: float) -> DataFrame:
    x, y = F.col("__fa"), F.col("__fb")
    return (pairs.join(left.select(a, F.col(fp).alias("__fa")), a)
            .join(right.select(b, F.col(fp).alias("__fb")), b)
            .filter(_alike(x, y, t)).select(a, b, tanimoto(x, y).alias("similarity")))


def similar_pairs(df: DataFrame, ident: str, fp: str, t: float) -> DataFrame:
    """Pairs (id_a < id_b) of distinct sets with Tanimoto >= t, each set under its smallest id.

    Rows that hold equal sets stay folded: `copies` lists them, one link per row instead of a pair
    for every two copies.
    """
    sets = materialise(distinct_sets(_held(df, ident, fp), ident, fp, [ident]).withColumnRenamed(ident, "id_a"))
    prefixes = materialise(_prefixes(sets, "id_a", fp, _rarity([sets], fp), t))
    other = prefixes.withColumnRenamed("id_a", "id_b")
    pairs = _candidates(prefixes, other, "id_a", "id_b", t, itself=True)
    return _verified(pairs, sets, sets.withColumnRenamed("id_a", "id_b"), "id_a", "id_b", fp, t)


def _split(df: DataFrame, memory: DataFrame, ident: str, fp: str, t: float, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a set, ids of those that resemble a memory set).

    Existence is enough, so each candidate first meets only a few memory sets per token; whatever is
    settled there, such as a mass of near copies, never meets the rest.
    """
    rows = _held(df, ident, fp)
    cand = materialise(distinct_sets(rows, ident, fp, [ident]).withColumnRenamed(ident, "__c"))
    known = materialise(_held(memory, fp).distinct().withColumn("__m", F.monotonically_increasing_id()))
    rarity = _rarity([cand, known], fp)
    mine = materialise(_prefixes(cand, "__c", fp, rarity, t))
    theirs = materialise(_prefixes(known, "__m", fp, rarity, t))
    hits, rest = [], mine
    if largest_group(theirs, ["token"]) > slice_rows:
        few = top_per_key(theirs, ["token"], ["n", "__m"], slice_rows)
        quick = _verified(_candidates(mine, few, "__c", "__m", t), cand, known, "__c", "__m", fp, t)
        hits.append(materialise(quick.select("__c").distinct()))
        rest = mine.join(hits[0], "__c", "left_anti")
    hits.append(_verified(_candidates(rest, theirs, "__c", "__m", t), cand, known, "__c", "__m", fp, t).select("__c"))
    found = hits[0] if len(hits) == 1 else hits[0].unionAll(hits[1])
    sets = cand.join(found.distinct(), "__c", "left_semi").select(F.col(fp))
    return rows, rows.join(sets, fp, "left_semi").select(ident)


def similar_ids(df: DataFrame, memory: DataFrame, ident: str, fp: str, t: float, slice_rows: int = 64) -> DataFrame:
    """Ids of `df` that resemble at least one set of `memory`."""
    return _split(df, memory, ident, fp, t, slice_rows)[1]


def novel(df: DataFrame, memory: DataFrame, ident: str, fp: str, t: float = 0.65, slice_rows: int = 64) -> DataFrame:
    """Rows below Tanimoto t to every memory row; rows with an empty set are invalid and dropped."""
    rows, close = _split(df, memory, ident, fp, t, slice_rows)
    return df.join(rows.select(ident).join(close, ident, "left_anti"), ident, "left_semi")


def nearest_active(df: DataFrame, actives: DataFrame, ident: str, target: str, fp: str, label: str, order,
                   similarity=tanimoto, t: float = 0.4, chunk: int = 256, bits=F.size, **how) -> DataFrame:
    """Most similar active of the same target, first in `order` on a tie; defaults 0, '' and novel.

    Actives are sorted by their number of bits (`bits` counts them) and packed into chunks of bounded length. Tanimoto is at most
    the smaller number over the larger one. So a candidate first meets the chunks nearest in bits, and then only those whose
    bound reaches the best it found there; only its best per chunk is shuffled.
    """
    best = _nearest(df, actives, ident, target, fp, label, order, similarity, chunk, bits, **how)
    s = F.coalesce(F.col("__b.s"), F.lit(0.0))
    return df.join(best.select(ident, F.round(s, 6).alias("similarity"),
                               F.when(s > 0, F.col("__b.l").cast("string")).otherwise("").alias("closest"),
                               (s < t).alias("is_novel")), ident)


def _nearest(df: DataFrame, actives: DataFrame, ident: str, target: str, fp: str, label: str, order, similarity, chunk: int, bits, **how) -> DataFrame:
    """(ident, __b, __met): similarity, place and label of the best active, and how many actives were compared."""
    placed = number_rows(actives.select(F.col(target), F.col(label), F.col(fp).alias("__af"), *[
        c for c in sort_names(order) if c not in (target, label)]), order, [target], "__p", **how)
    sorted_ = number_rows(placed.select(target, label, "__af", "__p", bits(F.col("__af")).alias("__n")), ["__n", "__p"], [target], "__q", **how)
    packed = materialise(sorted_.withColumn("__chunk", F.floor((F.col("__q") - 1) / chunk)).groupBy(target, "__chunk").agg(
        F.collect_list(F.struct((-F.col("__p")).alias("p"), F.col(label).alias("label"), F.col("__af").alias("fp"))).alias("__chunk_rows"),
        F.min("__n").alias("__lo"), F.max("__n").alias("__hi")))
    listed = packed.groupBy(target).agg(F.collect_list(F.struct(F.col("__chunk").alias("c"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))).alias("__chunks"))
    rows, small = packed.drop("__lo", "__hi"), fits_broadcast(packed)

    def meet(cand: DataFrame) -> DataFrame:
        on = [target, "__chunk"]
        joined = cand.join(F.broadcast(rows), on, "left") if small else salted_join(cand, rows, on, "left")
        value = F.array_max(F.transform("__chunk_rows", lambda a: F.struct(
            F.coalesce(similarity(F.col(fp), a["fp"]), F.lit(0.0)).alias("s"), a["p"].alias("p"), a["label"].alias("l"))))
        return joined.withColumn("__found", value).withColumn("__count", F.coalesce(F.size("__chunk_rows"), F.lit(0))).drop("__chunk_rows")

    def reach(e: Column) -> Column:
        n = F.col("__n")
        return F.when(n < e["lo"], n / e["lo"]).when(n > e["hi"], e["hi"] / n).otherwise(F.lit(1.0))
    cand = df.select(ident, target, fp, bits(F.col(fp)).alias("__n")).join(F.broadcast(listed) if fits_broadcast(listed) else listed, target, "left")
    cand = materialise(cand.withColumn("__near", F.array_max(F.transform("__chunks", reach)) * _NEAR))
    first = cand.withColumn("__chunk", F.explode_outer(F.filter("__chunks", lambda e: reach(e) >= F.col("__near")))).withColumn("__chunk", F.col("__chunk.c"))
    first = materialise(meet(first.select(ident, target, fp, "__chunk")).groupBy(ident).agg(F.max("__found").alias("__found"), F.sum("__count").alias("__count")))
    open_ = F.filter("__chunks", lambda e: (reach(e) < F.col("__near")) & (reach(e) >= F.coalesce(F.col("__found.s"), F.lit(0.0)) - _EPS))
    more = meet(cand.join(first, ident).select(ident, target, fp, F.explode(open_).alias("__e")).select(ident, target, fp, F.col("__e.c").alias("__chunk")))
    both = first.select(ident, "__found", "__count").unionByName(more.select(ident, "__found", "__count"))
    return both.groupBy(ident).agg(F.max("__found").alias("__b"), F.sum("__count").alias("__met"))


# --- greedy selection ----------------------------------------------------------------------

def leader_filter(df: DataFrame, ident: str, fp: str, order, t: float = 0.85, *, key: str | None = None, visible: int = 256, **how) -> DataFrame:
    """Walk rows in `order`; keep a row unless it resembles (>= t) a row kept before.

    A row without a set (null or empty) resembles none and stays; with `key` it stays if it is the first of its key without a set.
    Solved in rounds instead of row by row. Per token only the `visible` best undecided rows are
    paired. A row that is among them for all its tokens sees every better rival; if none resembles
    it, it is kept, and everything that resembles a kept row is rejected. The best undecided row is
    always decided, so the rounds end, and a cluster of near copies goes in one round.
    """
    names = list(dict.fromkeys([ident, *([key] if key else []), *sort_names(order)]))
    whole = materialise(df.select(*names, fp))
    bare = whole.filter(F.col(fp).isNull() | (F.size(fp) == 0)).drop(fp)
    bare = dedup_first(bare, [key], order) if key else bare
    kept = _leaders(whole.filter(F.size(fp) > 0).select(*names, fp), ident, fp, order, t, visible, **how)
    return df.join(kept.select(ident).unionAll(bare.select(ident)), ident, "left_semi")


def _leaders(rows: DataFrame, ident: str, fp: str, order, t: float, visible: int, **how) -> DataFrame:
    """The rows with a set that `leader_filter` keeps."""
    sets = materialise(number_rows(distinct_sets(rows, ident, fp, order), order, (), "__a", **how).select(ident, fp, "__a"))
    live = materialise(_prefixes(sets, "__a", fp, _rarity([sets], fp), t))
    if largest_group(live, ["token"]) <= visible:
        lost = settle(_rivals(live, live, sets, fp, t))
        return sets.join(lost, "__a", "left_anti") if lost is not None else sets
    return sets.join(_leaders_by_rounds(live, sets, fp, t, visible), "__a", "left_semi")


def _rivals(better: DataFrame, worse: DataFrame, sets: DataFrame, fp: str, t: float, ranked: bool = True) -> DataFrame:
    """Similar pairs (a, b) over shared prefix tokens; `ranked` pairs rows with themselves and keeps a before b."""
    other = worse.withColumnRenamed("__a", "__b")
    pairs = _candidates(better, other, "__a", "__b", t, itself=ranked)
    return _verified(pairs, sets, sets.withColumnRenamed("__a", "__b"), "__a", "__b", fp, t).select("__a", "__b")


def settle(edges: DataFrame) -> DataFrame | None:
    """Rows a greedy walk rejects, from all similar pairs (a before b); rounds over the pairs only."""
    edges, lost = materialise(edges), None
    while not edges.isEmpty():
        losing = edges.select(F.col("__b").alias("__a")).distinct()
        sure = edges.select("__a").distinct().join(losing, "__a", "left_anti")
        gone = materialise(edges.join(sure, "__a", "left_semi").select(F.col("__b").alias("__a")).distinct())
        lost = gone if lost is None else lost.unionAll(gone)
        # A rejected row no longer counts on either side; a sure one has done its work.
        done = gone.unionAll(sure)
        edges = materialise(edges.join(done, "__a", "left_anti")
                            .join(gone.withColumnRenamed("__a", "__b"), "__b", "left_anti").select("__a", "__b"))
    return lost


def _leaders_by_rounds(live: DataFrame, sets: DataFrame, fp: str, t: float, visible: int) -> DataFrame:
    """Kept rows when some token is shared by more than `visible` rows."""
    kept = None
    while not live.isEmpty():
        seen = materialise(top_per_key(live, ["token"], ["__a"], visible))
        whole = (live.groupBy("__a").agg(F.count(F.lit(1)).alias("all"))
                 .join(seen.groupBy("__a").agg(F.count(F.lit(1)).alias("shown")), "__a")
                 .filter("all = shown").select("__a"))
        blocked = _rivals(seen, seen, sets, fp, t).select(F.col("__b").alias("__a")).distinct()
        accepted = materialise(whole.join(blocked, "__a", "left_anti"))
        leaders, others = live.join(accepted, "__a", "left_semi"), live.join(accepted, "__a", "left_anti")
        rejected = _rivals(leaders, others, sets, fp, t, ranked=False).select(F.col("__b").alias("__a"))
        live = materialise(others.join(rejected.distinct(), "__a", "left_anti"))
        kept = accepted if kept is None else kept.unionAll(accepted)
    return kept


def diverse_top_n(df: DataFrame, ident: str, fp: str, order, t: float, n: int, *, sets: Column | None = None, first: int = 4, growth: int = 4) -> DataFrame:
    """The first `n` rows a best-to-worst walk keeps when it skips rows similar (>= t) to kept ones; rows without a set are skipped.

    What becomes of a row depends on better rows only. So the walk of `leader_filter` takes the best `first` * n rows and, while
    it keeps fewer than n, `growth` times as many. `sets` is an expression that makes the column `fp`: then it is made for these
    rows only. No set reaches the driver.
    """
    order, k = as_list(order), max(first * n, 1000)
    names = list(dict.fromkeys([ident, *sort_names(order)]))
    while True:
        best = materialise(df.select(*names).orderBy(*sort_cols(order)).limit(k))
        whole = best.count() < k
        head = best.select(ident)
        # Written before the filter below, which would otherwise be pushed under the join and make the sets of all rows.
        rows = df if whole else df.join(F.broadcast(head) if k <= 1_000_000 else head, ident, "left_semi")
        rows = materialise(rows if sets is None else rows.withColumn(fp, sets))
        kept = materialise(leader_filter(rows.filter(F.size(fp) > 0), ident, fp, order, t).orderBy(*sort_cols(order)).limit(n))
        if whole or kept.count() == n:
            return kept
        k *= growth


def filter_novel(df: DataFrame, memory: DataFrame, ident: str, fp: str, order, t: float = 0.65, **how) -> DataFrame:
    """Rows unlike the memory and, in arrival order, unlike each other; rows without a set are invalid and dropped."""
    return leader_filter(novel(df, memory, ident, fp, t), ident, fp, order, t, **how)
