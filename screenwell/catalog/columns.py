"""Scalar columns: calibration, classes, gates, time, text, fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fingerprints as fp
from ..functions.quasi import PRIMES, radical_inverse
from ..runtime import spread
from .base import query

_KIND = {"view": "zinc15", "click": "pulse", "signup": "ref", "purchase": "generate", "error": "manual"}


def source_of(event_type="event_type"):
    """Event types stand in for row sources."""
    out = F
    for k, v in _KIND.items():
        out = out.when(F.col(event_type) == k, v)
    return out


SOURCE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items()) + " END"


@query("P1", "SELECT event_id, round(value * -30.0, 3) AS affinity FROM events")
def to_affinity(t):
    return t.events.select("event_id", C.to_affinity("value").alias("affinity"))


@query("P2", """
SELECT event_id, coalesce(round(value * -30.0, 3) <= CASE WHEN event_type <> 'error' THEN -1500.0 END, false) AS hit
FROM events""")
def is_hit(t):
    limit = F.when(F.col("event_type") != "error", -1500.0)
    return t.events.select("event_id", C.is_hit(C.to_affinity("value"), limit).alias("hit"))


@query("P3", f"""
SELECT event_id, CASE WHEN s IN ('ref', 'reference') THEN 'reference'
  WHEN s IN ('zinc15', 'zinc15-fallback', 'mutant', 'generate', 'pulse') THEN 'novel' ELSE 'other' END AS source_class
FROM (SELECT event_id, {SOURCE_SQL} AS s FROM events)""")
def source_class(t):
    return t.events.select("event_id", C.source_class(source_of()).alias("source_class"))


@query("P4", """
SELECT event_id, TRY_CAST(score AS DOUBLE) AS score
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'view' THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS score FROM events)
WHERE TRY_CAST(score AS DOUBLE) > 0 AND NOT isnan(TRY_CAST(score AS DOUBLE))""")
def valid_score(t):
    text = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "NaN").otherwise(
        F.col("value").cast("string"))
    rows = C.valid_score(t.events.select("event_id", text.alias("score")), "score", positive=True)
    return rows.select("event_id", C.numeric_score("score").alias("score"))


@query("P5", r"""
SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, 'Br|Cl|[BCNOPSFI]|[bcnops]|\*'),
       lambda a: upper(a[1]) || lower(a[2:])))) AS elements
FROM (SELECT doc_id, replace(replace(text, '[', ' '), ']', ' ') AS text FROM documents)""")
def elements(t):
    text = F.translate("text", "[]", "  ")
    return t.documents.select("doc_id", F.array_sort(C.elements(text)).alias("elements"))


@query("P5", r"""
SELECT doc_id, length(text) > 0 AND len(list_filter(regexp_extract_all(text, 'Br|Cl|[BCNOPSFI]|[bcnops]|\*'),
       lambda a: a IN ('B', 'b', 'P', 'p', '*'))) = 0 AS ok
FROM (SELECT doc_id, replace(replace(text, '[', ' '), ']', ' ') AS text FROM documents)""")
def no_banned(t):
    return t.documents.select("doc_id", C.no_banned(F.translate("text", "[]", "  ")).alias("ok"))


@query("P6", """
SELECT 'generate' AS profile, p_partkey FROM part WHERE p_retailprice - 700 BETWEEN 200 AND 600 AND p_size <= 10 AND p_brand <> 'Brand#7'
UNION ALL SELECT 'actives', p_partkey FROM part WHERE p_retailprice - 700 BETWEEN 200 AND 800 AND length(p_name) >= 4
UNION ALL SELECT 'fragment', p_partkey FROM part WHERE p_retailprice - 700 BETWEEN 200 AND 300 AND p_size <= 5 AND p_size <= 25
UNION ALL SELECT 'sweep', p_partkey FROM part WHERE p_size BETWEEN 15 AND 55""")
def property_gate(t):
    mol = t.part.select("p_partkey", (F.col("p_retailprice") - 700).alias("mw"), F.col("p_size").alias("rot_bonds"),
                        F.col("p_size").alias("heavy_atoms"), (F.col("p_brand") == "Brand#7").alias("pains"),
                        F.col("p_name").alias("smiles"))
    parts = [C.property_gate(mol, p).select(F.lit(p).alias("profile"), "p_partkey") for p in C.PROFILES]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


_PROXY_SQL = """
CASE WHEN p_size BETWEEN 15 AND 55 AND p_brand <> 'Brand#7' THEN
  0.4 * exp(-abs(p_size / 30.0 - 1) / 0.3) + 0.3 * exp(-abs(((p_retailprice - 900) / 20) / 3.0 - 1) / 0.5) + 0.2 +
  0.1 * least(1.0, -(k * log2(k) + (1 - k) * log2(1 - k)) / 0.5) ELSE 0 END"""
PROXY_SQL = f"""SELECT p_partkey, p_name, p_type, round(CAST({_PROXY_SQL} AS DOUBLE), 6) AS proxy
FROM (SELECT *, (p_partkey % 100 + 20) / 167.0 AS k FROM part)"""


def proxy_of_parts(t):
    """Parts as molecules: size as heavy atoms, price as logP, key as number of set keys."""
    score = C.proxy_score("p_size", (F.col("p_retailprice") - 900) / 20, F.col("p_partkey") % 100 + 20,
                          F.col("p_brand") != "Brand#7")
    return t.part.select("p_partkey", "p_name", "p_type", F.round(score, 6).alias("proxy"))


@query("P7", PROXY_SQL)
def proxy_score(t):
    return proxy_of_parts(t)


@query("P8", f"""SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'SMALL') AND proxy <= 0 THEN 0.5 ELSE proxy END AS proxy
FROM ({PROXY_SQL})""")
def with_baseline(t):
    return proxy_of_parts(t).select("p_partkey", C.with_baseline("proxy", "p_type", ["LARGE", "SMALL"]).alias("proxy"))


@query("P9", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  round(coalesce(CASE WHEN l_returnflag <> 'R' THEN l_discount * 10 END, 0.5) *
        least(coalesce(CASE WHEN l_linestatus = 'F' THEN l_quantity / 4 END, 6.0) / 9.0, 1.0), 6) AS seed_score
FROM lineitem""")
def seed_score(t):
    qed = F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 10)
    potency = F.when(F.col("l_linestatus") == "F", F.col("l_quantity") / 4)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                             F.round(C.seed_score(qed, potency), 6).alias("seed_score"))


@query("P10", "SELECT doc_id, substr(md5(text), 1, 16) AS key FROM documents")
def content_key(t):
    return t.documents.select("doc_id", C.content_key("text").alias("key"))


@query("P11", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 'kinase'
  WHEN c_mktsegment = 'BUILDING' THEN 'protease' END AS family FROM customer""")
def target_family(t):
    families = {"kinase": ("FURNITURE", "MACHINERY"), "protease": ("BUILDING",)}
    return t.customer.select("c_custkey", C.target_family("c_mktsegment", families).alias("family"))


@query("P12", """
SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') OR p_brand = 'Brand#1' THEN 'mRNA' ELSE 'protein' END AS kind FROM part""")
def target_kind(t):
    name = F.concat("p_type", F.when(F.col("p_type").isin("SMALL", "LARGE"), "_mRNA").otherwise(""))
    declared = F.when(F.col("p_brand") == "Brand#1", "mRNA")
    return t.part.select("p_partkey", C.target_kind(name, declared).alias("kind"))


_BITS_SQL = "list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END)"
SIGN_SQL = "list_filter(range(0, 64), lambda i: embedding[i + 1] > 0)"


@query("P13", f"""
SELECT vec_id, array_to_string({_BITS_SQL}, '') AS fp_bs, {SIGN_SQL} AS fp FROM embeddings""")
def bit_text(t):
    bits = t.embeddings.select("vec_id", fp.array_to_bits(fp.sign_bits("embedding"), 64).alias("fp_bs"))
    return bits.select("vec_id", "fp_bs", fp.bits_to_array("fp_bs").alias("fp"))


@query("P14", """
SELECT doc_id, coalesce(len(bits), 0) AS n_on, CAST(list_sum(bits) AS BIGINT) AS bit_sum, bits[1] AS first_bit
FROM (SELECT doc_id, list_sort(list_distinct(list_transform(
        list_distinct(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))),
        lambda g: CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 2048))) AS bits FROM documents)""")
def qgram_fp(t):
    """A text of fewer than four characters has no bit, and so no sum and no first one; neither has a null."""
    rows = spread(t.documents.select("doc_id", "text"))
    sets = rows.select("doc_id", fp.qgram_md5_fp("text", 4, 2048).alias("fp"))
    total = F.when(F.size("fp") > 0, F.aggregate("fp", F.lit(0).cast("long"), lambda x, bit: x + bit))
    return sets.select("doc_id", F.coalesce(F.array_size("fp"), F.lit(0)).cast("long").alias("n_on"), total.alias("bit_sum"), F.get("fp", F.lit(0)).alias("first_bit"))


@query("P15", f"""
WITH e AS (SELECT vec_id, label, {SIGN_SQL} AS fp FROM embeddings),
     f AS (SELECT a.vec_id, a.fp AS x, b.fp AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM f""")
def tanimoto(t):
    e = t.embeddings.select("vec_id", fp.sign_bits("embedding").alias("x"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(fp.tanimoto("x", "y"), 6).alias("similarity"))


@query("P15", f"""
WITH e AS (SELECT vec_id, label, {SIGN_SQL} AS fp FROM embeddings),
     f AS (SELECT a.vec_id, a.fp AS x, b.fp AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS word_similarity,
       round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS packed_similarity FROM f""")
def tanimoto_packed(t):
    e = t.embeddings.select("vec_id", fp.sign_word("embedding").alias("x"),
                            fp.pack_words(fp.sign_bits("embedding"), 64).alias("px"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"), F.col("px").alias("py"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(fp.tanimoto_word("x", "y"), 6).alias("word_similarity"),
        F.round(fp.tanimoto_packed("px", "py", 1), 6).alias("packed_similarity"))


def _powers(base: int) -> str:
    return ", ".join(f"{base ** k}::BIGINT" for k in range(int(63 / math.log2(base))))


_INDICES = "(SELECT o_orderkey FROM orders UNION ALL SELECT 9007199254740993 + o_orderkey * 1048576 FROM orders)"


@query("P16", """
SELECT o_orderkey, """ + ", ".join(
    f"round((SELECT sum((o_orderkey // p) % {b} / (p::DOUBLE * {b})) FROM (SELECT unnest([{_powers(b)}]) AS p)), 9) AS h{b}"
    for b in PRIMES) + f" FROM {_INDICES}")
def halton(t):
    """Order keys and far larger numbers, beyond what a double holds exactly."""
    far = t.orders.select((F.col("o_orderkey") * 1048576 + 9007199254740993).alias("o_orderkey"))
    return t.orders.select("o_orderkey").unionAll(far).select("o_orderkey", *[
        F.round(radical_inverse("o_orderkey", b), 9).alias(f"h{b}") for b in PRIMES])


@query("P17", """
SELECT event_id, epoch_us(ts) // 86400000000 AS day,
       strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
       strftime(ts, '%Y-%m-%d') AS date, epoch_us(ts) > 1706572800000000 - 864000000000 AS recent FROM events""")
def time_columns(t):
    sec = C.unix_seconds("ts")
    return t.events.select("event_id", C.epoch_day(sec).alias("day"), C.iso_ts(sec).alias("iso"),
                           F.substring(C.iso_ts(sec), 1, 10).alias("date"),
                           C.within(sec, 1706572800.0, 864000.0).alias("recent"))


@query("P18", """
SELECT doc_id, 'gen:' || substr(text, 1, 20) AS label, coalesce(CASE WHEN lang <> 'en' THEN lang END, 'general') AS family,
       substr(upper(trim(source, ' ')), 1, 4) AS shown FROM documents""")
def text_columns(t):
    return t.documents.select("doc_id", C.method_label("text").alias("label"),
                              C.or_general(F.when(F.col("lang") != "en", F.col("lang"))).alias("family"),
                              C.shown_id("source", 4).alias("shown"))


_ORD_SQL = """o_orderkey || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st'
  WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END"""


@query("P19", f"""
SELECT o_orderkey, {_ORD_SQL} AS ordinal,
       'Discovery #' || o_orderkey || ' — ' || o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS name FROM orders""")
def ordinal(t):
    return t.orders.select("o_orderkey", C.ordinal("o_orderkey").alias("ordinal"), C.discovery_name(
        "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), "Discovery").alias("name"))


@query("P20", """
SELECT o_orderkey, doc, 'data:application/json;base64,' || base64(encode(doc)) AS uri FROM (SELECT o_orderkey,
 '{"name":"Discovery #' || o_orderkey || '","symbol":"ORD","description":"Order of ' || o_custkey ||
 '","image":"https://example.org/' || o_orderkey || '.png","external_url":"https://example.org","attributes":[{"trait_type":"target_id","value":"' || o_orderpriority || '"},{"trait_type":"discovery_number","value":"' || o_orderkey ||
 '"}],"properties":{"category":"image","creators":[{"address":"' || o_custkey || '","share":100}]}}' AS doc FROM orders)""")
def metadata_json(t):
    doc = C.metadata_json(F.concat(F.lit("Discovery #"), F.col("o_orderkey").cast("string")),
                          F.concat(F.lit("Order of "), F.col("o_custkey").cast("string")),
                          {"target_id": F.col("o_orderpriority"), "discovery_number": F.col("o_orderkey")},
                          F.col("o_custkey").cast("string"), "ORD",
                          F.format_string("https://example.org/%d.png", "o_orderkey"), F.lit("https://example.org"))
    return t.orders.select("o_orderkey", doc.alias("doc")).withColumn("uri", F.regexp_replace(C.data_uri("doc"), "\\s", ""))


@query("P21", """
SELECT c_custkey, regexp_matches(replace(c_name, '#', 'x') || 'QmYwAPJzv5CZsnA', '^[1-9A-HJ-NP-Za-km-z]{32,44}$') AS ok FROM customer""")
def is_address(t):
    text = F.concat(F.replace("c_name", F.lit("#"), F.lit("x")), F.lit("QmYwAPJzv5CZsnA"))
    return t.customer.select("c_custkey", C.is_address(text).alias("ok"))


@query("P22", "SELECT doc_id, md5(text) AS digest FROM documents")
def strip_nulls(t):
    dirty = F.concat_ws("\x00", F.col("text"), F.lit(""))
    return t.documents.select("doc_id", F.md5(C.strip_nulls(dirty)).alias("digest"))


@query("P23", "SELECT doc_id, strlen(text) + 1 >= 1024 AND lang = 'en' AS ok FROM documents")
def valid_alignment(t):
    text = F.concat(F.when(F.col("lang") == "en", ">").otherwise("x"), F.col("text"))
    return t.documents.select("doc_id", C.valid_alignment(text).alias("ok"))


@query("P24", """
SELECT event_type, user_id, CASE WHEN sum(value) > 0 THEN round(max(value) * 100.0 / sum(value), 2) END AS percent FROM events GROUP BY 1, 2""")
def pct(t):
    g = t.events.groupBy("event_type", "user_id").agg(F.max("value").alias("m"), F.sum("value").alias("s"))
    return g.select("event_type", "user_id", C.pct("m", "s").alias("percent"))


@query("P25", """
SELECT event_id, round(value / 7, 4) AS d4, round(value / 7, 3) AS d3, round(value / 7, 2) AS d2, round(value / 7, 6) AS d6 FROM events""")
def rounding(t):
    return t.events.select("event_id", *[F.round(F.col("value") / 7, d).alias(f"d{d}") for d in (4, 3, 2, 6)])


@query("P26", """
WITH a AS (SELECT p_partkey, p_name, CASE WHEN p_size > 20 THEN p_brand END AS aligned FROM part)
SELECT p_partkey, coalesce(aligned, p_name) AS sequence, coalesce(length(aligned) <> length(p_name), false) AS differs FROM a""")
def resolve_sequence(t):
    aligned = F.when(F.col("p_size") > 20, F.col("p_brand"))
    seq, differs = C.resolve_sequence(aligned, "p_name")
    return t.part.select("p_partkey", seq.alias("sequence"), differs.alias("differs"))


@query("P27", """
SELECT event_id, coalesce(json_extract_string(props, '$.current_target'), json_extract_string(props, '$.k')) AS v FROM events""")
def json_get(t):
    return t.events.select("event_id", C.json_get("props", "$.current_target", "$.k").alias("v"))


@query("P28", "SELECT c_nationkey, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2")
def map_columns(t):
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").count()
    return C.from_map(C.to_map(counts, "c_mktsegment", "count", ["c_nationkey"]), "entries", "segment", "n")


@query("P29", "SELECT event_id, least(100.0, value * 100.0 / 400) AS gauge FROM events")
def gauge(t):
    return t.events.select("event_id", C.gauge("value", 400.0).alias("gauge"))


@query("W2", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS discovery_number,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS discovery_rank FROM orders""")
def number_discoveries(t):
    from ..operators.windows import number_discoveries as number
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    return number(rows, "o_orderpriority", ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "discovery_number", "discovery_rank")


