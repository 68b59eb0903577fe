"""Ranked lexical search by NRA, no random access (after Fagin, Lotem and Naor 2001), in rounds over a shared table.

Every term has a list of its documents by falling impact, cut into blocks: the first holds about `FIRST_BLOCK` entries, each
further one `GROWTH` times as many as all before it. A round reads one more block of every list. For each document met it holds
an interval: the impacts read so far, and these plus the most that each list in which it was not met can still give. An
item is closed when no unmet document can reach its k-th lower end; then only documents whose upper end reaches it are
followed, until the intervals of all that are left are points. Lists are read from their heads only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from . import kernels as K
from .shared import bounded, dropped, kept

# Terms are the maximal runs of digits, letters and characters beyond ASCII; A-Z become a-z.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
FIRST_BLOCK, GROWTH, BLOCKS = 1024, 4, 16
# Impacts are below 2^20; blocks begin at multiples of 2^BUCKET_BITS.
BUCKET_BITS = 10
# Words of all items that are looked up in a broadcast dictionary; beyond it the terms of documents meet theirs in a join.
MOST_WORDS, MOST_WORD_BYTES = 500_000, 16_000_000
# Rows of up to 200 bytes that may be broadcast (20 MB).
SMALL_ROWS = 100_000


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text; null has none."""
    return text.translate(_FOLD).split() if text else []


def term_id(word: bytes) -> int:
    return K.signed(xxh3_64_intdigest(word))


def _item_terms(batches):
    for batch in batches:
        rows = [(i, w, term_id(w), q) for i, text in zip(batch.column(0).to_pylist(), K.raw(batch.column(1))) for w, q in Counter(terms(text)).items()]
        item, word, term, q = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(word, pa.binary()), pa.array(term, pa.int64()), pa.array(q, pa.int64())],
                                         ["item", "word", "term", "q"])


def _doc_terms(words: dict | None):
    def run(batches):
        for batch in batches:
            ids, sizes, found, counts, lens = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), K.raw(batch.column(1))):
                own = terms(text)
                if not own:
                    continue
                c = Counter(own if words is None else filter(words.__contains__, own))
                ids.append(i), sizes.append(len(own)), lens.append(len(c) + 1)
                found += [None, *(map(term_id, c) if words is None else map(words.__getitem__, c))]
                counts += [0, *c.values()]
            place = np.repeat(np.arange(len(ids)), np.array(lens, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(place)), pa.array(np.array(sizes, np.int64)[place]),
                                              pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["doc", "n", "term", "tf"])
    return run


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, word, term, q): how often each item says each of its terms; rows of one item are taken together."""
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).filter("item is not null")
    return rows.mapInArrow(_item_terms, "item long, word binary, term long, q long").groupBy("item", "word", "term").agg(F.sum("q").alias("q"))


def postings(docs: DataFrame, ident: str, text: str, asked: DataFrame) -> DataFrame:
    """(doc, n, term, tf) of every document for the terms that are asked for, and one row of null term for its length n."""
    words = asked.select("word", "term").distinct()
    size = words.limit(MOST_WORDS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    known = {bytes(r["word"]): r["term"] for r in words.collect()} if size[0] <= MOST_WORDS and size[1] <= MOST_WORD_BYTES else None
    rows = docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_doc_terms(known), "doc long, n long, term long, tf long")
    if known is None:
        rows = rows.filter("term is null").unionByName(rows.join(words.select("term"), "term", "left_semi"))
    return kept(rows, "postings")


def as_documents(rows: DataFrame) -> DataFrame:
    """`postings` in which the rows of an id that occurs more than once are summed, as the terms of one document."""
    again = rows.filter("term is null and doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("whole")).filter("k > 1")
    again = kept(again.select("doc", "whole"), "repeated")
    if not again.limit(1).count():
        return rows
    some = bounded(again)
    summed = rows.join(some, "doc").groupBy("doc", F.col("whole").alias("n"), "term").agg(F.sum("tf").alias("tf"))
    out = kept(rows.join(some, "doc", "left_anti").select("doc", "n", "term", "tf").unionByName(summed.select("doc", "n", "term", "tf")), "postings")
    dropped(rows, again)
    return out


def impact(n_docs: int, n_terms: int) -> Column:
    """What one posting (n, tf) is worth before the weight of its term, below 10^6; all in 64-bit integers."""
    length = F.expr(f"75 + ((25 * n * {n_docs}L) div {max(n_terms, 1)}L)")
    return F.call_function("div", F.expr("1000000000L * tf"), F.expr("1000 * tf") + 12 * length)


def _block(before: Column) -> Column:
    """The block of a bucket that has `before` entries above it in its list."""
    return sum((before >= FIRST_BLOCK * GROWTH ** k).cast("int") for k in range(BLOCKS))


def impact_lists(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lists in blocks (block, term, doc, impact); (term, weight); and (term, block, most): the greatest impact in a block."""
    n_docs, n_terms = rows.filter("term is null").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    valued = rows.filter("term is not null").select("term", "doc", impact(n_docs, n_terms).alias("impact")).withColumn(
        "bucket", F.shiftright("impact", BUCKET_BITS).cast("int"))
    # At most 2^(20 - BUCKET_BITS) buckets a term, whatever the length of its list.
    counted = kept(valued.groupBy("term", "bucket").agg(F.count(F.lit(1)).alias("k"), F.max("impact").alias("most")), "buckets")
    above = Window.partitionBy("term").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.withColumn("block", _block(F.coalesce(F.sum("k").over(above), F.lit(0))))
    weights = counted.groupBy("term").agg(F.sum("k").alias("df")).select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("weight"))
    tops = kept(blocks.groupBy("term", "block").agg(F.max("most").alias("most"), F.min("bucket").alias("low")), "blocks")
    edges = tops.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("block", "low"))).alias("edges"))
    placed = valued.filter("doc is not null").join(bounded(edges, SMALL_ROWS), "term").select(
        F.expr("filter(edges, e -> bucket >= e.low)[0].block").alias("block"), "term", "doc", "impact")
    lists = placed.repartitionByRange("block", "term", F.desc("impact"), "doc").sortWithinPartitions("block", "term", F.desc("impact"), "doc")
    lists = kept(lists.select("term", "doc", "impact", "block"), "lists", by="block")
    weights = kept(weights, "weights")
    dropped(counted)
    return lists, weights, tops.select("term", "block", "most")


def _followed(read: DataFrame, wanted: DataFrame, alive: DataFrame | None) -> DataFrame:
    """(item, doc, got, open) for the entries read: of every document, or only of the followed ones (item, doc)."""
    if alive is None:
        hits = read.join(bounded(wanted, SMALL_ROWS), "term")
    else:
        hits = read.join(bounded(alive.join(bounded(wanted, SMALL_ROWS), "item"), SMALL_ROWS), ["term", "doc"])
    return hits.select("item", "doc", (F.col("impact") * F.col("weight")).alias("got"), "open")


def best_matches(docs: DataFrame, items: DataFrame, k: int = 20, ident: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """The `k` best documents of every item: item, `rank` (int, from 1), id and `score` (long).

    Terms are the maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ in the whole text, only A-Z lower-cased; null has
    none. With N documents that have a term, L terms in all, n terms in a document, df documents that hold a term and tf
    occurrences in one, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a document's m is 100 - 25 + (25nN div L) and
    its score the sum of w * (1000000000tf div (1000tf + 12m)) over the item's terms, repeats included. Scores above 0 are
    ranked, highest first, equal ones by rising id; fewer than `k` are returned if there are no more.

    Rows that repeat an id are one document of all their terms; rows with a null id count in N, L and df and are not returned.
    Rows that repeat an item are one item; items with a null id or without a term give no row. Further columns are ignored;
    an empty table on either side gives an empty result.
    """
    asked = kept(item_terms(items, item, text), "asked")
    rows = as_documents(postings(docs, ident, text, asked))
    lists, weights, tops = impact_lists(rows)
    terms_of = kept(asked.join(bounded(weights), "term").select("item", "term", (F.col("q") * F.col("weight")).alias("weight")).filter("weight > 0"), "terms")
    last = tops.agg(F.max("block")).first()[0]
    unmet, alive, done, spent = terms_of.select("item").distinct(), None, [], [asked, rows, weights, terms_of]
    for block in range(-1 if last is None else last + 1):
        rest = tops.filter(F.col("block") > block).groupBy("term").agg(F.max("most").alias("rest"))
        wanted = terms_of.join(bounded(rest, SMALL_ROWS), "term", "left").select(
            "item", "term", "weight", (F.col("weight") * F.coalesce("rest", F.lit(0))).alias("open"))
        read = lists.filter(F.col("block") <= block)
        hits = _followed(read, wanted.join(bounded(unmet, SMALL_ROWS), "item", "left_semi"), None)
        if alive is not None:
            hits = hits.unionByName(_followed(read, wanted, alive))
        met = kept(hits.groupBy("item", "doc").agg(F.sum("got").alias("low"), F.sum("open").alias("met")), "met")
        # The k-th lower end of every item, 0 if fewer were met, and the most that an unmet document can have.
        ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low"), "doc"))).filter(F.col("r") <= k)
        limit = ranked.groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).otherwise(0).alias("kth"))
        limit = wanted.groupBy("item").agg(F.sum("open").alias("most")).join(limit, "item").withColumn(
            "closed", (F.col("most") < F.col("kth")) | (F.col("most") == 0))
        limit = kept(limit, "limits")
        left = met.join(bounded(limit, SMALL_ROWS), "item").filter("closed and low + most - met >= kth").select(
            "item", "doc", "low", (F.col("most") > F.col("met")).alias("loose"))
        left = kept(left, "alive")
        loose = kept(left.filter("loose").select("item").distinct(), "loose")
        final = left.join(bounded(loose, SMALL_ROWS), "item", "left_anti").withColumn(
            "rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low"), "doc"))).filter(F.col("rank") <= k)
        done.append(kept(final.select("item", "rank", "doc", "low"), "found"))
        before = [x for x in (alive, unmet) if x is not None and block]
        unmet = kept(unmet.join(bounded(limit.filter("closed").select("item"), SMALL_ROWS), "item", "left_anti"), "unmet")
        alive = kept(left.join(bounded(loose, SMALL_ROWS), "item", "left_semi").select("item", "doc"), "followed")
        dropped(met, limit, left, loose, *before)
        if not unmet.limit(1).count() and not alive.limit(1).count():
            break
    dropped(lists, tops, *spent)
    found = done[0] if done else terms_of.sparkSession.createDataFrame([], "item long, rank int, doc long, low long")
    for x in done[1:]:
        found = found.unionByName(x)
    return found.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(ident), F.col("low").alias("score"))
