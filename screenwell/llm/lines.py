"""Line deduplication; DataFrame functions only.

Every line is reduced to the two 64-bit hashes of its key. The distinct documents of a key are counted by two aggregations,
both summed map-side, so that a line of very many documents is no hot group. What a document loses is then found by a join on
the hashes (which Spark can split where one line is hot), gathered as line positions, and its text is put together without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import dropped, kept

WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """The lines between the \\n of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def key_hash(key: Column) -> list[Column]:
    """128 bits of a key, as two longs of different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def hashed_lines(docs: DataFrame, ident: str, text: str, least_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of every line whose key has at least `least_chars` code points; `row` hashes the text."""
    lines = docs.select(F.col(ident).alias("id"), F.xxhash64(F.col(text)).alias("row"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    return lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= least_chars).select("id", "row", "pos", *key_hash(F.col("key")))


def repeated_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, keeper) of the keys found in at least `least_docs` documents; `keeper` is the smallest id among them."""
    once = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return once.groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.min("id").alias("keeper")).filter(
        F.col("docs") >= least_docs).select("h1", "h2", "keeper")


def without(lines: Column, places: Column) -> Column:
    """The lines whose position is not among `places`, joined by \\n, after one sort and one pass.

    Every place is set beside its line as a marker; the line that follows its own marker goes.
    """
    marks = F.transform(places, lambda p: F.struct(p.alias("pos"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    whole = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("kind"), x.alias("line")))
    run = F.array_sort(F.concat(marks, whole))
    before = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(1).alias("kind"), F.lit("").alias("line"))), run)
    left = F.filter(F.arrays_zip(run.alias("at"), before.alias("last")),
                    lambda z: (z["at"]["kind"] == 1) & ~((z["last"]["kind"] == 0) & (z["last"]["pos"] == z["at"]["pos"])))
    return F.array_join(F.transform(left, lambda z: z["at"]["line"]), "\n")


def repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """(id, row, places) of the texts that lose lines: `places` are positions, from 0; `row` is the hash of the whole text."""
    lines = kept(hashed_lines(docs, ident, text, least_chars), "lines")
    shared = kept(repeated_keys(lines, least_docs), "repeated")
    lost = lines.join(shared, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    # collect_set: a row that is there twice marks its lines once.
    out = kept(lost.groupBy("id", "row").agg(F.collect_set("pos").alias("places")), "places")
    dropped(lines, shared)
    return out


def drop_repeated_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", least_chars: int = 10, least_docs: int = 2,
                        n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """`docs` with all columns and rows, `text` without the lines that earlier documents hold.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at least `least_chars` code points
    found in at least `least_docs` documents lose all their lines except in the smallest id that holds them, where repeats stay
    too. Other lines stay as they are, joined by \\n. A document is an id: rows that repeat an id are one document and share its
    verdicts; all rows with a null id are one more document, which comes after every other. A null text stays null when it
    loses nothing (it has one empty line, whose key is too short unless `least_chars` is 0). `n_lines` and `n_dropped` name
    columns to add: lines before dropping, lines dropped. Further columns are kept whatever their names; an empty table gives an
    empty result.
    """
    lost = repeats(docs, ident, text, least_chars, least_docs)
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    cond = F.col(f"d.`{ident}`").eqNullSafe(F.col("l.id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("l.row"))
    both = docs.alias("d").join(lost.alias("l"), cond, "left")
    lines = split_lines(F.col(f"d.`{text}`"))
    changed = F.when(F.col("l.places").isNull(), F.col(f"d.`{text}`")).otherwise(without(lines, F.col("l.places")))
    extra = [F.size(lines).cast("long").alias(n_lines)] if n_lines else []
    extra += [F.coalesce(F.size(F.col("l.places")), F.lit(0)).cast("long").alias(n_dropped)] if n_dropped else []
    return both.select(*[changed.alias(c) if c == text else own[i] for i, c in enumerate(docs.columns)], *extra)
