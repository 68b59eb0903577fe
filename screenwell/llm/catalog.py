"""Registered queries of the text operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bytebpe, chat, exact, gnat, html, jaccard, langid, lines, nbsvm, packing, rules, search, spans
from .tokenizers import tokenizer_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, table) -> DataFrame, where table(name) reads one of the tables."""
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query()
def op1_language_id(spark: SparkSession, table) -> DataFrame:
    docs = table("documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.learn_dictionaries(docs.filter(~held_out))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
    list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
  n AS (SELECT doc_id, len(s) AS n FROM s),
  t AS (SELECT doc_id, unnest(s) AS t FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
  r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2""")
def op2_ngram_jaccard_join(spark: SparkSession, table) -> DataFrame:
    return jaccard.jaccard_components(table("documents"))


@query()
def op3_html_extraction(spark: SparkSession, table) -> DataFrame:
    return html.extract(table("pages"))


@query()
def op4_packing(spark: SparkSession, table) -> DataFrame:
    return packing.pack(table("documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


@query()
def op5_quality_rules(spark: SparkSession, table) -> DataFrame:
    docs = table("documents")
    return rules.judge(docs, rules.learn_rules(docs, table("labels")))


@query()
def op6_quality_classifier(spark: SparkSession, table) -> DataFrame:
    docs, labels = table("documents"), table("labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = nbsvm.fit(docs, labels.filter(~held_out))
    return nbsvm.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query(r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
  k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""")
def op7_exact_dedup(spark: SparkSession, table) -> DataFrame:
    return exact.exact_groups(table("documents"), capacity=32_768)


@query()
def op8_substring_dedup(spark: SparkSession, table) -> DataFrame:
    """The remaining text of every document, with what was removed from it."""
    return spans.remove_repeats(table("documents"))


_CONVERSATIONS = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  t AS (SELECT *, 23 + length(role) + length(text) + 2 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<|', '<')) + length(role)
    - length(replace(role, '\', '')) + length(role) - length(replace(role, '<|', '<')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


@query(_CONVERSATIONS)
def op9_chat_formatting(spark: SparkSession, table) -> DataFrame:
    """Prompts, responses and other turns come as records of three layouts; digests are read back from the formatted text."""
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(
        "assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table("conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    record = F.when(F.col("role") == "user", F.to_variant_object(F.struct("turn", F.col("text").alias("prompt")))).when(
        F.col("role") == chat.ASSISTANT, F.to_variant_object(F.struct("turn", F.col("text").alias("response")))).otherwise(
        F.to_variant_object(F.struct("turn", "role", "text")))
    records = rows.select("conv_id", "turn", record.alias("record"))
    turns = chat.canonical_turns(records).select("conv_id", "turn", F.posexplode("turns").alias("place", "said")).select(
        "conv_id", "turn", "place", "said.role", "said.text")
    out = chat.format_turns(turns, "conv_id", ["turn", "place"]).withColumn("back", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda m: chat.unescaped(F.substr("formatted", m["begin"] + 1, m["length"]))), "")
    return out.withColumn("loss", loss).select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@query()
def op10_byte_bpe(spark: SparkSession, table) -> DataFrame:
    from public_tokenizers import PATTERN
    return bytebpe.digest_round_trip(table("documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), PATTERN)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents),
  t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
  q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark) GROUP BY 1, 2),
  c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS len FROM d WHERE len(w) > 0),
  p AS (SELECT doc_id, n, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY 1, 2, 3),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
  s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // len))))) AS BIGINT) AS score
    FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20""")
def op11_lexical_search(spark: SparkSession, table) -> DataFrame:
    return search.best_matches(table("documents"), table("benchmark"), 20)


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
  k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
  r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
  j AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""")
def op12_line_dedup(spark: SparkSession, table) -> DataFrame:
    docs = table("documents").select("doc_id", "text")
    out = lines.drop_repeated_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op13_hard_negatives(spark: SparkSession, table) -> DataFrame:
    rows = table("embeddings")
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat.hard_negatives(rows.withColumn("label", flipped), F.col("vec_id") % 100 == 0)
