"""Substring deduplication by sliding sentence spans.

From every sentence runs the shortest span of consecutive sentences with enough words, forwards and backwards. Spans are
hashed and joined over the whole corpus; the first place of each (document, then position) keeps it, and sentences covered by
any other place are removed. Inside one document a task sees by itself which places are not the first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .shared import bounded, dropped, kept

# A sentence ends after closing marks or a line break, or before a capitalised word. UTF-8 bytes C3 80-9E are the capitals À-Þ.
# A match begins where marks or white space begin, and takes them whole, so a long run of either is read once.
SENTENCE = re.compile(rb"(?<![.!?])[.!?]++[\x20\x09-\x0D]++|(?<![\x20\x09-\x0D])(?:[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*|[\x20\x09-\x0D]++(?=[A-Z]|\xc3[\x80-\x9e]))")


def sentences(text: bytes) -> list[bytes]:
    """The text cut into sentences, each with the white space behind it; joined, they are the text again."""
    ends = [m.end() for m in SENTENCE.finditer(text)]
    cuts = [0, *[e for e in ends if 0 < e < len(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def runs(parts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, hash) of the spans of a document's sentences."""
    items = [p.split() for p in parts]
    sizes = np.array([len(x) for x in items], np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    filled = np.flatnonzero(sizes)
    if not len(filled) or upto[-1] < least:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    ends = np.searchsorted(upto, upto[filled] + least)  # the span [filled, ends) is the shortest with enough words
    forward = ends <= len(items)
    begins = np.searchsorted(upto, upto[filled + 1] - least, "right") - 1
    backward = upto[filled + 1] >= least
    codes = np.unique(np.concatenate([filled[forward] << 32 | ends[forward], begins[backward] << 32 | filled[backward] + 1]))
    first, end = codes >> 32, codes & 0xFFFFFFFF
    # The polynomial over the word hashes gives a span's hash from two prefixes, so overlapping spans cost nothing.
    words = K.mixed(K.hash_all([w for x in items for w in x]))
    powers = np.cumprod(np.full(len(words), 0xD6E8FEB86659FD93, np.uint64)) if len(words) else words
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    a, b = upto[first], upto[end]
    return first, end, K.mixed((sums[b] - sums[a]) * _inverse(len(words))[a] + (b - a).astype(np.uint64))


def _inverse(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64))


def later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands further ahead."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def _spans(least: int):
    def run(batches):
        for batch in batches:
            rows = [(i, *runs(sentences(t), least)) for i, t in zip(batch.column(0).to_pylist(), K.raw(batch.column(1))) if t]
            lens = [len(r[1]) for r in rows]
            ids = np.repeat(np.array([r[0] for r in rows], np.int64), lens)
            first, end, key = (np.concatenate([r[k] for r in rows]) if rows else np.empty(0, np.int64) for k in (1, 2, 3))
            again = np.concatenate([later(r[3]) for r in rows]) if rows else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.uint64).view(np.int64)), pa.array(ids), pa.array(first.astype(np.int32)),
                                              pa.array(end.astype(np.int32)), pa.array(again)], ["span", "id", "first", "end", "again"])
    return run


def _cut(batches):
    for batch in batches:
        texts, gone, words = [], [], []
        for text, places in zip(K.raw(batch.column(1)), batch.column(2).to_pylist()):
            parts = sentences(text)
            out = set()
            for place in places:
                out.update(range(place["first"], min(place["end"], len(parts))))
            texts.append(b"".join(p for k, p in enumerate(parts) if k not in out))
            gone.append(len(out))
            words.append(sum(len(parts[k].split()) for k in out))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *[pa.array(x, pa.int32()) for x in (gone, words)]],
                                         ["id", "text", "n_removed", "removed_words"])


def repeated_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 25) -> DataFrame:
    """Per document with any: id and `places`, the (first, end) of every repeated span that is not the first of its kind; sentences
    count from 0. The result is a table in the shared folder."""
    rows = docs.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    # Hashing costs far more than these narrow rows, which are read twice.
    spans = kept(rows.mapInArrow(_spans(least), "span long, id long, first int, end int, again boolean"), "spans")
    # Only fixed-width numbers are folded, so a hot span is one row of each map task.
    home = spans.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("home")).filter("n > 1").select("span", "home")
    home = kept(home, "homes")
    gone = spans.join(bounded(home), "span").filter("again or id <> home")
    out = kept(gone.groupBy("id").agg(F.collect_set(F.struct("first", "end")).alias("places")), "places")  # one document's sentences
    dropped(spans, home)
    return out


def _parted(docs: DataFrame, ident: str, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` without and with a document in `places`, the latter with its places as one more column at the end.
    Texts of the former stay where they are. Columns are told apart by their table, whatever their names."""
    known, own = bounded(places.select("id")).alias("k"), docs.alias("d")
    same = F.col(f"d.`{ident}`").cast("long")
    hit = own.join(known, same == F.col("k.id"), "left_semi").alias("d").join(places.alias("p"), same == F.col("p.id"))
    return (own.join(known, same == F.col("k.id"), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns]),
            hit.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("p.places")))


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 25) -> DataFrame:
    """Per row of `docs`: its id, `text` without the repeated sentences, `n_removed` and `removed_words`.

    A span needs `least` words; words are compared exactly, white space between them is not. The place with the smallest
    (id, position) keeps a span. Null texts stay null, empty ones empty; a text of too few words is left alone; rows with a
    null id are neither compared nor changed; rows that repeat an id are one document, whose rows are not compared with each
    other but are all cut alike. Further columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    same, hit = _parted(rows, "id", repeated_spans(docs, ident, text, least))
    cut = hit.filter("text is not null").select("id", "text", "places").mapInArrow(_cut, "id long, text string, n_removed int, removed_words int")
    none = [F.lit(0).alias("n_removed"), F.lit(0).alias("removed_words")]
    return same.select("id", "text", *none).unionByName(hit.filter("text is null").select("id", "text", *none)).unionByName(cut).withColumnRenamed("id", ident)


def cut_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = 25) -> DataFrame:
    """`docs` with all columns, its texts without repeated sentences, and without the rows whose texts have no word left.

    A row that had no word before stays. Only rows with something to remove are joined by shuffle.
    """
    same, hit = _parted(docs, ident, repeated_spans(docs, ident, text, least))
    fields = docs.schema
    at = fields.names.index(text)

    def run(batches):
        for batch in batches:
            data, places = batch.column(at), batch.column(batch.num_columns - 1)
            done = next(_cut([pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), data.fill_null(""), places], ["id", "text", "places"])]))
            texts = done.column(1).cast(data.type)
            # A null text stays null; a text that lost its last word goes.
            left = [was is None or bool(new.split()) or not was.split() for was, new in zip(K.raw(data), K.raw(texts))]
            new = pc.if_else(pc.is_null(data), pa.scalar(None, data.type), texts)
            columns = [new if k == at else batch.column(k) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays(columns, fields.names).filter(pa.array(left, pa.bool_()))
    cut = hit.toDF(*[f"c{k}" for k in range(len(fields) + 1)]).mapInArrow(run, fields)
    return same.unionByName(cut)
