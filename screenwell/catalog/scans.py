"""Sources and sinks: each query writes files of the driver tables with Spark and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import unix_seconds
from ..runtime import fresh_dir
from ..sources import files, records, sinks
from .base import query

_SCORE_LOG = "event_id BIGINT, ts DOUBLE, target_id STRING, boltz_score STRING, source STRING"


def _score_lines(events):
    """The events as score-log lines; the writer of an 'error' row died half-way through its line."""
    row = F.to_json(F.struct("event_id", unix_seconds("ts").alias("ts"), F.col("event_type").alias("target_id"),
                             F.col("value").alias("boltz_score"), F.col("props").alias("source")))
    whole = F.when(F.col("event_type") == "error", F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line"))
    return events.withColumn("line", row).select(whole.alias("value"))


@query("S1", """
SELECT event_id, event_type AS target_id, CAST(value AS VARCHAR) AS score_text, value AS score
FROM events WHERE event_type <> 'error'""")
def read_log(t):
    path = fresh_dir(t.spark, "log")
    _score_lines(t.events).write.text(path)
    log = files.read_log(t.spark, path, _SCORE_LOG)
    score = F.col("boltz_score").cast("double")
    return log.select("event_id", "target_id", F.col("boltz_score").alias("score_text"), score.alias("score"))


@query("S1", """
SELECT event_type = 'error' AS malformed, count(*) AS n,
       CAST(sum(CASE WHEN event_type <> 'error' THEN event_id END) AS BIGINT) AS ids
FROM events GROUP BY 1""")
def malformed_lines(t):
    path = fresh_dir(t.spark, "log")
    _score_lines(t.events).write.text(path)
    log = files.read_log(t.spark, path, _SCORE_LOG, keep_malformed=True)
    bad = F.col(files.CORRUPT).isNotNull()
    return (log.groupBy(bad.alias("malformed"))
            .agg(F.count("*").alias("n"), F.sum(F.when(~bad, F.col("event_id"))).alias("ids")))


@query("S2", """
SELECT split_part(p_name, ' ', 1) AS smiles, count(*) AS n FROM part GROUP BY 1""")
def read_smi(t):
    path = fresh_dir(t.spark, "smi")
    lines = t.part.select(F.concat(F.lit(" "), "p_name").alias("value"))
    header = t.part.limit(1).select(F.lit("smiles zinc_id").alias("value"))
    lines.unionAll(header).unionAll(header.select(F.lit("").alias("value"))).write.text(path)
    return files.read_smi(t.spark, path).groupBy("smiles").agg(F.count("*").alias("n"))


@query("S3", """
SELECT split_part(p_name, ' ', 1) AS smiles, tranche, count(*) AS n
FROM (SELECT p_name, substr(p_type, 1, 3) || chr(CAST(65 + floor(p_size / 10) AS INTEGER)) AS tranche FROM part)
WHERE tranche[4] IN ('A', 'B') AND tranche[1:2] IN ('LA', 'SM', 'PR') GROUP BY 1, 2""")
def read_tranches(t):
    path = fresh_dir(t.spark, "tranches")
    code = F.concat(F.substring("p_type", 1, 3), F.chr(F.lit(65) + F.floor(F.col("p_size") / 10)))
    t.part.select(F.col("p_name").alias("value"), code.alias("tranche")).write.partitionBy("tranche").text(path)
    return (files.read_smi(t.spark, path, last_letters="AB", tranches=["LA", "SM", "PR"])
            .groupBy("smiles", "tranche").agg(F.count("*").alias("n")))


@query("S4", """
SELECT doc_id || ' ' || lang AS header, length(seq) AS n, md5(seq) AS digest
FROM (SELECT doc_id, lang, array_to_string(list_filter(list_transform(string_split(replace(replace(text, '>', ''), chr(13), ''), chr(10)),
      lambda s: trim(s, ' ')), lambda s: s <> ''), '') AS seq FROM documents)""")
def read_fasta(t):
    path = fresh_dir(t.spark, "fasta")
    body = F.translate("text", ">\r", "")
    t.documents.select(F.concat(F.lit(">"), "doc_id", F.lit(" "), "lang", F.lit("\n"), body)).write.text(path)
    return files.read_fasta(t.spark, path).select(
        "header", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


def _write_alignments(t, path):
    """One alignment per language: documents in order, the first one is the query."""
    body = F.translate("text", ">\r", "")
    rec = F.concat(F.lit(">"), "doc_id", F.lit("\n"), body)
    # Range partitions: part numbers follow (language, document), so a large alignment is several files in order.
    (t.documents.select(rec.alias("value"), F.col("lang").alias("uniprot_id"), "doc_id")
     .repartitionByRange("uniprot_id", "doc_id").sortWithinPartitions("uniprot_id", "doc_id").drop("doc_id")
     .write.partitionBy("uniprot_id").text(path))


@query("S5", """
SELECT lang AS uniprot_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
       CAST(doc_id AS VARCHAR) AS header FROM documents""")
def read_a3m(t):
    path = fresh_dir(t.spark, "a3m")
    _write_alignments(t, path)
    return files.read_a3m(t.spark, path).select("uniprot_id", F.col("pos").cast("long").alias("pos"), "header")


@query("A23", """
SELECT lang AS uniprot_id, count(*) AS depth, CAST(sum(length(seq)) AS BIGINT) AS residues
FROM (SELECT lang, array_to_string(list_filter(list_transform(string_split(replace(replace(text, '>', ''), chr(13), ''), chr(10)),
      lambda s: trim(s, ' ')), lambda s: s <> ''), '') AS seq FROM documents) GROUP BY 1""")
def msa_depth(t):
    path = fresh_dir(t.spark, "a3m")
    _write_alignments(t, path)
    return files.msa_depth(files.read_a3m(t.spark, path))


@query("S6", """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS gene_name,
       CASE WHEN s_acctbal > 0 THEN -s_acctbal ELSE -7.0 END AS target_score_threshold,
       CASE WHEN s_nationkey < 10 THEN s_nationkey ELSE 9 END AS difficulty_tier FROM supplier""")
def read_targets(t):
    path = fresh_dir(t.spark, "targets")
    target = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("gene_name"),
                      F.when(F.col("s_acctbal") > 0, -F.col("s_acctbal")).alias("target_score_threshold"),
                      F.when(F.col("s_nationkey") < 10, F.col("s_nationkey")).alias("difficulty_tier"))
    few = F.floor(F.col("s_suppkey") / 50)  # an array of at most 50 targets per line
    t.supplier.groupBy(few.alias("k")).agg(F.to_json(F.collect_list(target)).alias("value")).select("value").write.text(path)
    return files.read_targets(t.spark, path, whole_files=False).select("id", "gene_name", "target_score_threshold", "difficulty_tier")


@query("S7", """
SELECT l_orderkey || l_returnflag AS target_id, CAST(arg_max(l_partkey, l_partkey) AS VARCHAR) AS smiles FROM lineitem GROUP BY 1""")
def read_reference_compounds(t):
    path = fresh_dir(t.spark, "compounds")
    entry = F.struct("l_partkey", F.concat(F.col("l_orderkey").cast("string"), "l_returnflag").alias("target_id"),
                     F.col("l_partkey").cast("string").alias("smiles"))
    document = F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("compounds")))  # the few lines of one order
    t.lineitem.groupBy("l_orderkey").agg(document.alias("value")).select("value").write.text(path)
    return files.read_reference_compounds(t.spark, path, whole_files=False)


@query("S8", """
SELECT CAST(l_partkey AS VARCHAR) AS target_chembl_id, CAST(l_quantity AS VARCHAR) AS pchembl_value,
       l_returnflag AS standard_type, l_linestatus AS assay_type, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4""")
def read_activity_pages(t):
    path = fresh_dir(t.spark, "pages")
    activity = F.struct(F.col("l_partkey").cast("string").alias("target_chembl_id"),
                        F.col("l_quantity").cast("string").alias("pchembl_value"),
                        F.col("l_returnflag").alias("standard_type"), F.col("l_linestatus").alias("assay_type"))
    t.lineitem.groupBy("l_orderkey").agg(F.collect_list(activity).alias("activities")).drop("l_orderkey").write.json(path)
    return (files.read_activity_pages(t.spark, path)
            .groupBy("target_chembl_id", "pchembl_value", "standard_type", "assay_type").agg(F.count("*").alias("n")))


_TAG = bytes([1, 35, 69, 103, 137, 171, 205, 239])


@query("S9", """
SELECT o_orderkey, upper(sha256(CAST(o_custkey AS VARCHAR))) AS owner_hex,
       CAST(round(o_totalprice * 1000000) AS BIGINT) AS total_earned, o_custkey AS molecules_screened,
       o_orderkey % 1000 AS last_epoch, o_orderstatus = 'F' AS is_registered,
       CAST(o_orderpriority[1] AS INTEGER) AS submission_count
FROM orders WHERE o_orderstatus <> 'P'""")
def decode_records(t):
    u = records.encode_unsigned
    tag = F.when(F.col("o_orderstatus") == "P", F.unhex(F.lit("00" * 8))).otherwise(F.lit(_TAG))
    blob = F.concat(tag, F.unhex(F.sha2(F.col("o_custkey").cast("string"), 256)),
                    u(F.round(F.col("o_totalprice") * 1_000_000).cast("long"), 8), u("o_custkey", 8),
                    u(F.col("o_orderkey") % 1000, 8), u((F.col("o_orderstatus") == "F").cast("int"), 1), u(F.lit(255), 1),
                    u(F.substring("o_orderpriority", 1, 1).cast("int"), 1), u("o_orderkey", 8))
    rows = records.decode_records(t.orders.select("o_orderkey", blob.alias("data")), "data", "submitter_account", _TAG,
                                  keep=["o_orderkey"])
    return rows.select("o_orderkey", F.hex("owner").alias("owner_hex"), F.col("total_earned").cast("long").alias("total_earned"),
                       F.col("molecules_screened").cast("long").alias("molecules_screened"),
                       F.col("last_epoch").cast("long").alias("last_epoch"), "is_registered", "submission_count")


def _single(x):
    """The four bytes of a float that is neither zero nor tiny, put together from its sign, exponent and fraction."""
    size = F.abs(x.cast("double"))
    guess = F.floor(F.log2(size))
    power = guess - F.when(F.pow(F.lit(2.0), guess) > size, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), guess + 1) <= size, 1).otherwise(0)
    fraction = F.round((size / F.pow(F.lit(2.0), power) - 1) * (1 << 23)).cast("long")
    return records.encode_unsigned(F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)) + (power + 127).cast("long") * (1 << 23) + fraction, 4)


@query("X5", "SELECT vec_id, embedding[1] AS score, embedding[2] * 3 AS affinity, embedding[3] AS extra FROM embeddings")
def decode_floats(t):
    """Components of vectors as single floats of a record, read back by built-in arithmetic."""
    x = [F.get("embedding", F.lit(i)) for i in range(3)]
    blob = F.concat(F.lit(_TAG), records.encode_unsigned("vec_id", 8), _single(x[0]), _single((x[1] * F.lit(3).cast("float")).cast("float")), _single(x[2]))
    layout = [("vec_id", "u64"), ("score", "f32"), ("affinity", "f32"), ("extra", "f32")]
    rows = records.decode_records(t.embeddings.select(blob.alias("data")), "data", layout, _TAG)
    return rows.withColumn("vec_id", F.col("vec_id").cast("long"))


@query("S10", """
SELECT event_id, value AS power_draw, CAST(user_id AS DOUBLE) AS gpu_util, 'NVIDIA, ' || event_type AS name
FROM events WHERE event_type <> 'error'""")
def parse_telemetry(t):
    power = F.when(F.col("event_type") == "error", "[N/A]").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(", ", power, F.col("user_id").cast("string"), F.lit("55"), F.lit("1024"), F.lit("24576"),
                       F.concat(F.lit("NVIDIA, "), "event_type"))
    lines = t.events.select("event_id", line.alias("value"))
    return files.parse_telemetry(lines).select("event_id", "power_draw", "gpu_util", "name")


@query("S11", """
SELECT count(*) AS n_files, count(*) AS n_valid, CAST(min(b) AS BIGINT) AS min_bytes,
       CAST(max(b) AS BIGINT) AS max_bytes, round(avg(b), 3) AS avg_bytes
FROM (SELECT source, sum(strlen(text) + 1) AS b FROM documents GROUP BY 1)""")
def file_inventory(t):
    path = fresh_dir(t.spark, "files")
    t.documents.select(F.col("text").alias("value"), "source").write.partitionBy("source").text(path)
    keys = files.list_files(t.spark, path, "*.txt").groupBy("folder").agg(F.sum("length").alias("length"))
    out = files.file_inventory(keys, least=1)
    return out.withColumn("avg_bytes", F.round("avg_bytes", 3))


@query("K1", """
SELECT event_id, user_id, event_type, value FROM events""")
def append_log(t):
    path = fresh_dir(t.spark, "append")
    rows = t.events.select("event_id", "user_id", "value", "event_type")
    low = F.col("value") < 50
    sinks.append_log(rows.filter(low), path, by=["event_type"])
    sinks.append_log(rows.filter(~low), path, by=["event_type"])
    return t.spark.read.parquet(path).select("event_id", "user_id", "event_type", "value")


@query("K2", """
SELECT c_custkey, round(c_acctbal + 1, 2) AS c_acctbal FROM customer""")
def write_snapshot(t):
    root = fresh_dir(t.spark, "state")
    sinks.write_snapshot(t.customer.select("c_custkey", "c_acctbal"), root)
    state = sinks.read_snapshot(t.spark, root)
    sinks.write_snapshot(state.withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2)), root)
    return sinks.read_snapshot(t.spark, root)


@query("K3", """
WITH d AS (SELECT trim(text, ' ') AS smiles, doc_id FROM documents),
     b AS (SELECT trim(text, ' ') AS smiles, min(item_id) AS id FROM benchmark GROUP BY 1)
SELECT md5(smiles) AS k, id FROM b
UNION ALL
SELECT md5(smiles), min(doc_id) FROM d WHERE smiles <> '' AND smiles NOT IN (SELECT smiles FROM b) GROUP BY smiles""")
def register_new(t):
    known = t.benchmark.groupBy(F.trim("text").alias("smiles")).agg(F.min("item_id").alias("id"))
    incoming = t.documents.select(F.col("text").alias("smiles"), F.col("doc_id").alias("id"))
    return sinks.register_new(known, incoming, "smiles", ["id"]).select(F.md5("smiles").alias("k"), "id")


@query("K5", """
SELECT 'ok' AS part, doc_id FROM documents WHERE strlen(text) >= 1024
UNION ALL SELECT 'too small', doc_id FROM documents WHERE strlen(text) < 1024""")
def quarantine(t):
    path = fresh_dir(t.spark, "bad")
    reason = F.when(F.octet_length("text") < 1024, "too small")
    good = sinks.quarantine(t.documents.select("doc_id", "text"), path, reason).select(F.lit("ok").alias("part"), "doc_id")
    bad = (t.spark.read.option("sep", "\t").option("multiLine", True).option("escape", '\\')
           .schema("doc_id BIGINT, text STRING, reason STRING").csv(path))
    return good.unionAll(bad.select(F.col("reason").alias("part"), "doc_id"))
