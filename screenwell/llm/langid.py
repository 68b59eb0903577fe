"""Language identification by compression: text is encoded with one zstandard raw-content dictionary per language.

The language whose dictionary gives the fewest bytes wins; a narrow margin is rejected.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F


# The text is encoded in segments of so many bytes, so that the dictionary, not the text's own past, explains each of them.
SEGMENT = 2048


def learn_dictionaries(rows: DataFrame, lang: str = "lang", text: str = "text", ident: str = "doc_id", texts: int = 256,
                       slice_chars: int = 1024) -> dict[str, bytes]:
    """Raw-content dictionaries: for each language, at most `texts` labelled texts drawn by the hash of their id. Of each they hold
    `slice_chars` characters from a place that the hash gives, or all if there are fewer; only slices are moved. Rows without
    language or letters teach nothing."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "part")
    fit = rows.select(F.col(lang).alias("lang"), F.col(ident).alias("id"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    start = F.pmod(F.xxhash64("id", F.lit(11)), F.greatest(F.char_length("text") - slice_chars, F.lit(0)) + 1) + 1
    cut = fit.select("lang", "id", F.substring(F.col("text"), start.cast("int"), F.lit(slice_chars)).alias("part"))
    parts = cut.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= texts)
    out: dict[str, list[str]] = {}
    for r in parts.orderBy("lang", F.desc("rank")).collect():
        out.setdefault(r["lang"], []).append(r["part"])
    return {k: "\n".join(v).lower().encode() for k, v in out.items()}


def encoders(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    params = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=3, hash_log=17, chain_log=17, write_content_size=0,
        write_checksum=0, write_dict_id=0)
    out = {}
    for lang, content in sorted(dictionaries.items()):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        out[lang] = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
    return out


def sizes(text: bytes, coders: dict[str, zstandard.ZstdCompressor]) -> list[int]:
    """Encoded bytes of the whole text, in lower case, per language."""
    parts = [text[k:k + SEGMENT] for k in range(0, len(text), SEGMENT)]
    return [sum(len(c.compress(p)) for p in parts) for c in coders.values()]


def _predict(dictionaries, margin: float):
    shared = dictionaries.value

    def run(batches):
        coders = encoders(shared)
        names = list(coders)
        for batch in batches:
            lang, score, gap = [], [], []
            for text, lettered in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not lettered or not names:
                    lang.append("und"), score.append(0.0), gap.append(0.0)
                    continue
                found = sizes(text.lower().encode(), coders)
                best = min(range(len(names)), key=found.__getitem__)
                others = [n - found[best] for k, n in enumerate(found) if k != best]
                lang.append(names[best])
                # Every eight bytes saved make the language e times likelier than its rival.
                score.append(1.0 / (1.0 + sum(math.exp(-min(700.0, n / 8)) for n in others)))
                gap.append(min(others) / found[best] if others else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()),
                                              pa.array([g < margin for g in gap], pa.bool_())], ["id", "lang_pred", "score", "margin", "rejected"])
    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], ident: str = "doc_id", text: str = "text", margin: float = 0.01) -> DataFrame:
    """Per row: id, `lang_pred`, `score` (0 to 1), `margin` and `rejected`.

    `margin` is the runner-up's excess over the fewest bytes, relative to them; under the parameter `margin` the prediction is
    rejected, though still named. A null text, one without a letter, or a model without languages gives `und`, 0, rejected.
    Ties go to the first name. Ids may be null or repeat; further columns are ignored; an empty table gives an empty result.
    """
    data = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most texts * slice_chars characters a language
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"),
                       F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    out = rows.mapInArrow(_predict(data, margin), "id long, lang_pred string, score double, margin double, rejected boolean")
    return out.withColumnRenamed("id", ident)
