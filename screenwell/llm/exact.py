"""Exact deduplication over an extendible-hash index in shared files; DataFrame functions only.

Every text is reduced to the 64-bit key of its normalised form. A directory over the keys' leading bits doubles until no bucket
holds more than `capacity` keys; buckets that need no further split stay at their depth. Texts of keys that several rows have
are fetched, copies folded map-side, and sent to the owner of their bucket, a range of keys: there texts of one key are compared
byte by byte, and different ones form a chain. Equality is that of bytes; what stays and how large a group is comes from the chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import bounded, dropped, fresh_dir, kept

# A class with more than this part of all rows is joined by broadcast; there are at most so many such classes.
HOT_PARTS = 64
# Bits by which the directory grows at a time while it looks for its depth; all the bits of a key.
GROWN, KEY_BITS = 4, 64


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def key_of(norm: Column) -> Column:
    """The 64-bit key of a normalised text. Different texts may share one."""
    return F.xxhash64(norm)


def narrow(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """One small row per document: id, key and digest of the normalised text, and length (code points of the original)."""
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), normalised(F.col(text)).alias("norm"))
    return rows.select("id", key_of(F.col("norm")).alias("key"), F.unhex(F.sha2("norm", 256)).alias("digest"), _length().alias("length"))


def _length() -> Column:
    return F.char_length(F.coalesce("text", F.lit("")))


def _best() -> Column:
    """Of a group the row of most code points, then smallest id; null ids come after all others."""
    return F.max(F.struct(F.col("length"), F.col("id").isNotNull().alias("known"), (-F.col("id")).alias("low"), F.col("id")))


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("key", KEY_BITS - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(prefix, depth) for each prefix in use of the global depth that is returned too; `depth` is that of the bucket it belongs to.

    The directory doubles until no bucket of distinct keys is overfull; it has about twice as many rows as there are buckets.
    """
    bits = 0
    while bits < KEY_BITS and keys.groupBy(_prefix(bits).alias("prefix")).count().filter(F.col("count") > capacity).limit(1).count():
        bits += GROWN
    out = kept(keys.groupBy(_prefix(bits).alias("prefix")).count().withColumn("depth", F.lit(0)), "directory")
    for depth in range(bits):
        bucket = Window.partitionBy("depth", F.shiftright("prefix", bits - depth))
        full = (F.sum("count").over(bucket) > capacity) & (F.col("depth") == depth)
        split = out.withColumn("full", full)
        if not split.filter("full").limit(1).count():
            break
        last, out = out, kept(split.select("prefix", "count", (F.col("depth") + F.col("full").cast("int")).alias("depth")), "directory")
        dropped(last)
    return out.select("prefix", "depth"), bits


def build_index(docs: DataFrame, rows: DataFrame, ident: str, text: str, capacity: int = 1_000_000) -> DataFrame:
    """The index of the texts of `docs`, whose `narrow` rows are given: bucket, key, chain, texts (of the key), norm, group_size, keep_id.

    One entry per distinct normalised text. `norm` is there where a key has several texts, which are numbered as its chain. The
    row of most code points, then smallest id, stays.
    """
    keys = kept(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), _best().alias("best")), "keys")
    several = kept(keys.filter("n > 1").select("key"), "several")
    found = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), normalised(F.col(text)).alias("norm")).withColumn("key", key_of(F.col("norm")))
    # Bytes are compared here: first of the rows of a map task, so a mass of copies sends one text from each, then in the owner.
    same = found.join(bounded(several), "key", "left_semi").withColumn("length", _length()).groupBy("key", "norm").agg(
        F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
    single = keys.filter("n = 1").select("key", F.lit(None).cast("string").alias("norm"), F.col("n").alias("group_size"), "best")
    depths, bits = directory(keys.select("key"), capacity)
    entries = same.unionByName(single).withColumn("prefix", _prefix(bits)).join(bounded(depths), "prefix")
    owned = entries.withColumn("bucket", F.struct("depth", F.expr(f"shiftright(prefix, {bits} - depth)").alias("prefix")))
    chain = Window.partitionBy("bucket", "key")
    chained = owned.repartition("bucket").withColumns({"chain": F.row_number().over(chain.orderBy("norm")), "texts": F.count(F.lit(1)).over(chain)})
    out = chained.select("bucket", "key", "chain", "texts", F.when(F.col("texts") > 1, F.col("norm")).alias("norm"), "group_size", F.col("best.id").alias("keep_id"))
    path = fresh_dir(docs.sparkSession, "index")
    out.sortWithinPartitions("bucket", "key", "chain").write.parquet(path)
    dropped(keys, several, depths)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", capacity: int = 1_000_000) -> DataFrame:
    """Per row of `docs`: id, `keep_id`, `group_size`, `kept` and `text_sha256` of the normalised text.

    Texts are equal if they are identical without the characters [\\x20\\x09-\\x0D]; null, empty and blank texts are equal to each
    other. Of equal texts the one with most code points, then the smallest id, stays. Rows that repeat an id share its
    verdict; a null id is kept only if its whole group has none. Further columns are ignored; an empty table gives an empty
    result.
    """
    rows = kept(narrow(docs, ident, text), "digests")
    index = build_index(docs, rows, ident, text, capacity)
    total = rows.count()
    alone, verdict = index.filter("texts = 1"), ["key", "group_size", "keep_id"]
    large = F.col("group_size") * HOT_PARTS > total
    crowd = F.broadcast(alone.filter(large).select(verdict))  # at most HOT_PARTS entries
    found = rows.join(crowd, "key").unionByName(rows.join(crowd, "key", "left_anti").join(alone.filter(~large).select(verdict), "key"))
    # Rows of a key that several texts share find theirs by its bytes.
    shared = kept(index.filter("texts > 1"), "chains")
    if shared.limit(1).count():
        norm = docs.select(F.col(ident).alias("id"), normalised(F.col(text)).alias("norm")).withColumn("key", key_of(F.col("norm")))
        own = norm.join(shared.select("norm", *verdict), ["key", "norm"])
        found = found.unionByName(own.select("key", "id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.lit(0).alias("length"), "group_size", "keep_id"))
    return found.select(F.col("id").alias(ident), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all columns; rows with a null id stay, rows that repeat an id share a fate."""
    drop = kept(exact_groups(docs, ident, text).filter(~F.col("kept") & F.col(ident).isNotNull()).select(ident).distinct(), "drop")
    return docs.join(bounded(drop), ident, "left_anti").select(*docs.columns)
