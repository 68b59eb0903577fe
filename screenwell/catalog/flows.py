"""Streams, models, hooks and whole flows over the driver tables."""

from __future__ import annotations

import time
from functools import partial

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from ..functions.columns import content_key, proxy_score, unix_seconds
from ..functions.fingerprints import sign_bits
from ..operators import hooks as H
from ..operators import models as M
from ..operators import shingles as G
from ..plans import sweep as SW
from ..operators.ordering import number_rows
from ..runtime import fresh_dir, materialise
from ..streaming import streams as R
from .base import query
from .columns import SIGN_SQL
from .similar import _DOCS, _Q, _STEPS, document_set, texts

# --- streams: the table is landed as several files, then read as a stream ---------------------------


def landed(t, df, parts: int = 4, by: str = "event_id"):
    """Write a table as `parts` parquet files and open them as a stream, a file per batch."""
    path = fresh_dir(t.spark, "landed")
    df.repartitionByRange(parts, by).write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def landed_in_turn(t, *parts):
    """Write each part after the one before and open them as a stream, a file per batch in this order."""
    path = fresh_dir(t.spark, "landed")
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)  # files are read in the order of their times
    return t.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def quarters(df, by: str):
    """A table in four parts by the rank of `by`, as SQL's ntile makes them."""
    ranked = materialise(number_rows(df, [by], (), "__at"))
    size = df.count()
    large, least = size % 4, size // 4
    ends = [min(q, large) * (least + 1) + max(q - large, 0) * least for q in range(5)]
    return [ranked.filter((F.col("__at") > a) & (F.col("__at") <= b)).drop("__at") for a, b in zip(ends, ends[1:])]


@query("R1", "SELECT event_id, event_type AS target_id, value AS score FROM events WHERE event_type <> 'error'")
def stream_log(t):
    from ..sources.files import stream_log as tail
    from .scans import _SCORE_LOG, _score_lines
    path = fresh_dir(t.spark, "log")
    _score_lines(t.events.repartitionByRange(4, "event_id")).write.text(path)
    log = tail(t.spark, path, _SCORE_LOG, files_per_trigger=2)
    return R.drain(log.select("event_id", "target_id", F.col("boltz_score").try_cast("double").alias("score")))


@query("R2", """
SELECT epoch_us(ts) // 21600000000 * 21600 AS bucket_s, arg_max(event_type, value) AS target, round(max(value), 4) AS best_score FROM events GROUP BY 1""")
def stream_history(t):
    """The whole history of events in the order of their times, then the first ones again with greater values: too late by then, they change nothing."""
    events = t.events.select("ts", "value", "event_type")
    late = events.filter(F.col("ts") < F.lit("2024-01-02").cast("timestamp")).withColumn("value", F.col("value") + 1_000_000)
    live = R.stream_history(landed_in_turn(t, *quarters(events, "ts"), late), "ts", "value", "event_type", bucket="6 hours", late="8 days")
    rows = R.drain(live, "update", ["bucket"])
    return rows.select(F.unix_seconds("bucket").alias("bucket_s"), "target", "best_score")


@query("R3", "SELECT event_id, event_type FROM events")
def stream_dedup(t):
    """Every event is delivered again with the next part; keys are forgotten 12 days later."""
    events = t.events.select("event_id", "ts", "event_type")
    parts = quarters(events, "ts")
    again = [parts[0], *[a.unionAll(b) for a, b in zip(parts, parts[1:])], parts[-1]]
    live = R.stream_dedup(landed_in_turn(t, *again), "event_id", "ts", "12 days")
    return R.drain(live).select("event_id", "event_type")


@query("R4", _DOCS.format(order="doc_id", t=0.85) + _STEPS.format(order="doc_id", rows="d") + "SELECT doc_id FROM kept")
def stream_novel(t):
    """Documents in four parts, stopped after two and run again: what gets in is what one walk over all of them keeps."""
    rows, root, path = texts(t).select("doc_id", "text"), fresh_dir(t.spark, "novel"), fresh_dir(t.spark, "landed")
    lasts = [part.agg(F.max("doc_id")).first()[0] for part in quarters(t.documents.select("doc_id"), "doc_id")]
    first = [x for x in lasts if x is not None][:1]
    parts = [rows.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= first[0]) if first else F.lit(True))]
    parts += [rows.filter((F.col("doc_id") > a) & (F.col("doc_id") <= b)) for a, b in zip(lasts, lasts[1:]) if a is not None and b is not None]
    for some in (parts[:2], parts[2:]):
        for df in some:
            df.write.mode("append").parquet(path)
        live = t.spark.readStream.schema(rows.schema).parquet(path)
        out = R.stream_novel(live, "doc_id", "text", ["doc_id"], 0.85, root, partial(G.filter_novel, q=_Q))
    return out.select("doc_id")


@query("R5", """
SELECT event_type, count(*) AS attempts, count(CASE WHEN value > 20 THEN 1 END) AS passes, count(CASE WHEN value > 100 THEN 1 END) AS accepted
FROM events GROUP BY 1""")
def stream_counters(t):
    live = R.stream_counters(landed(t, t.events), "event_type", F.col("value") > 20, F.col("value") > 100)
    return R.drain(live, "update", ["event_type"])


@query("R6", "SELECT event_type, max(epoch_us(ts)) / 1000000.0 AS last_seen, 1706745600 - max(epoch_us(ts)) / 1000000.0 <= 86400 AS alive FROM events GROUP BY 1")
def stream_liveness(t):
    rows = landed(t, t.events).select("event_type", unix_seconds("ts").alias("s"))
    return R.drain(R.liveness(rows, "event_type", "s", 1_706_745_600.0, gap=86_400.0), "update", ["event_type"])


@query("R7", "SELECT event_id, value FROM events WHERE value > 0 ORDER BY value DESC, event_id LIMIT 50")
def stream_elite(t):
    return R.stream_elite(landed(t, t.events.select("event_id", "value")), "value", "event_id", 50)


@query("R8", """
SELECT event_type, list(event_id ORDER BY event_id) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events)
WHERE r <= 20 GROUP BY 1""")
def stream_last_n(t):
    held = R.stream_last_n(landed(t, t.events.select("event_type", "event_id")), "event_type", ["event_id desc"], 20)
    return held.groupBy("event_type").agg(F.sort_array(F.collect_list("event_id")).alias("recent"))  # at most 20


@query("R9", """
WITH RECURSIVE q AS (SELECT label, ntile(4) OVER (ORDER BY vec_id) AS part FROM embeddings), c AS (SELECT label, part, count(*) AS k FROM q GROUP BY 1, 2),
  s AS (SELECT DISTINCT label, 0 AS part, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS trained_n, CAST(0 AS BIGINT) AS fits FROM c UNION ALL
    SELECT label, part, n, CASE WHEN due THEN n ELSE trained_n END, CASE WHEN due THEN fits + 1 ELSE fits END FROM (
      SELECT *, n >= 10 AND (trained_n IS NULL OR n - trained_n >= 15) AS due FROM (
        SELECT s.label, s.part + 1 AS part, s.n + coalesce(c.k, 0) AS n, trained_n, fits FROM s LEFT JOIN c ON c.label = s.label AND c.part = s.part + 1 WHERE s.part < 4)))
SELECT label, n, trained_n, fits, fits AS noted FROM s WHERE part = 4""")
def stream_refit(t):
    """Rows per label in four parts; each due target is recorded where a fit would start."""
    log = fresh_dir(t.spark, "refits")
    note = lambda due, batch: due.write.mode("overwrite").parquet(f"{log}/b={batch}")
    parts = quarters(t.embeddings.select("vec_id", "label"), "vec_id")
    out = R.stream_refit(landed_in_turn(t, *parts), "label", note, least=10, grown=15)
    noted = t.spark.read.schema("label int, b int").parquet(log).groupBy("label").agg(F.count("*").alias("noted"))
    return out.join(noted, "label", "left").withColumn("noted", F.coalesce("noted", F.lit(0).cast("long")))


@query("R10", "SELECT split_part(p_name, ' ', 1) AS smiles, count(*) AS n FROM part GROUP BY 1")
def ingest_fragments(t):
    """Half of the files, then, from where that stopped, the other half, which has landed meanwhile."""
    path, root = fresh_dir(t.spark, "fragments"), fresh_dir(t.spark, "ingest")
    first, second, third, fourth = quarters(t.part.select("p_partkey", "p_name"), "p_partkey")
    for half in (first.unionAll(second), third.unionAll(fourth)):
        half.select("p_name").repartition(4).write.mode("append").text(path)
        rows = R.drain(R.ingest_fragments(t.spark, path, 2), path=root)
    return rows.groupBy("smiles").agg(F.count("*").alias("n"))


@query("R11", """
SELECT event_id, n_name, round(value * -30.0, 3) AS affinity, coalesce(round(value * -30.0, 3) <= -n_regionkey * 600.0, false) AS hit
FROM events LEFT JOIN nation ON n_nationkey = user_id // 2""")
def stream_hits(t):
    dim = t.nation.select(F.col("n_nationkey").alias("nation"), "n_name", (-F.col("n_regionkey") * 600.0).alias("limit"))
    rows = landed(t, t.events).withColumn("nation", F.floor(F.col("user_id") / 2))
    return R.drain(R.stream_hits(rows, dim, "nation", "value", "limit").select("event_id", "n_name", "affinity", "hit"))


@query("R12", """
SELECT event_type, event_id, round(value * -30.0, 3) AS affinity, round(coalesce(ref + 0.5, -900), 6) AS effective_threshold,
       round(value * -30.0, 3) <= coalesce(ref + 0.5, -900) AS hit
FROM (SELECT *, last_value(CASE WHEN value < 5 THEN round(value * -30.0, 3) END IGNORE NULLS)
        OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ref FROM events)""")
def stream_threshold(t):
    """Four parts in turn: a reference of one goes on to the next."""
    rows = t.events.select("event_type", "event_id", "value", (F.col("value") < 5).alias("is_ref"))
    out = R.stream_threshold(landed_in_turn(t, *quarters(rows, "event_id")), "event_type", "event_id", "value", "is_ref", own=-900.0)
    return out.withColumn("effective_threshold", F.round("effective_threshold", 6))


@query("R13", """
SELECT 'NVIDIA, ' || user_id AS name, arg_max(value, event_id) AS power_draw, max(event_id) AS at_event FROM events GROUP BY user_id""")
def stream_telemetry(t):
    line = F.concat_ws(", ", F.col("value").cast("string"), F.lit("50"), F.lit("61"), F.lit("1024"), F.lit("24576"),
                       F.concat(F.lit("NVIDIA, "), F.col("user_id").cast("string")))
    rows = landed(t, t.events.select("event_id", line.alias("value")))
    live = R.stream_telemetry(rows.withColumnRenamed("event_id", "at_event"), "at_event")
    return R.drain(live, "update", ["name"]).select("name", "power_draw", "at_event")


# --- models -------------------------------------------------------------------------------------------

def model_rows(t):
    """Vectors as molecules of three targets; the score to learn is a sum of components."""
    return library(t).withColumn("target", F.floor(F.col("label") / 4).cast("int"))


def library(t):
    comp = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return M.assemble(t.embeddings.select("vec_id", "label", sign_bits("embedding").alias("fp"), comp[0].alias("mw"), comp[1].alias("logp"),
                                          (comp[0] * 3 + comp[1] + comp[2]).alias("score")), "fp", 64, ("mw", "logp"))


_TARGETS = "SELECT CAST(floor(label / 4) AS INTEGER) AS target, count(*) AS n FROM embeddings GROUP BY 1"


@query("M1", f"""
SELECT vec_id, len({SIGN_SQL}) AS n_on, round(embedding[1], 6) AS mw FROM embeddings""")
def assemble(t):
    dense = model_rows(t).select("vec_id", vector_to_array("features").alias("v"))
    on = F.aggregate(F.slice("v", 1, 64), F.lit(0.0), lambda a, b: a + b)
    return dense.select("vec_id", on.cast("long").alias("n_on"), F.round(F.get("v", F.lit(64)).cast("float"), 6).alias("mw"))


@query("M2", f"SELECT target, CASE WHEN n < 30 THEN 'learning' ELSE 'ready' END AS status, n, n >= 30 AS useful, n >= 30 AS whole FROM ({_TARGETS})")
def train_targets(t):
    """The report, with whether the fit explains anything and whether the model has all its 200 trees of 31 nodes."""
    models, report = M.train_targets(model_rows(t), "target", "score", "vec_id")
    size = models.groupBy("target").agg(F.count("*").alias("rows"))
    return report.join(size, "target", "left").select("target", "status", "n", F.coalesce(F.col("r2") > 0.2, F.lit(False)).alias("useful"),
                                                      F.coalesce(F.col("rows") == 1 + 200 * 31, F.lit(False)).alias("whole"))


@query("M3", "SELECT TRUE AS useful, TRUE AS held FROM (SELECT count(*) FROM embeddings)")
def cv_r2(t):
    """The mean R2 over five folds of one model over all targets: it explains most of the score and stays in its range."""
    r2 = M.cv_r2(model_rows(t), "score", "vec_id")
    return t.spark.createDataFrame([(r2 > 0.5, -1 <= r2 <= 1)], "useful boolean, held boolean")


@query("M4", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, n, CASE WHEN label < 7 THEN n - label * 5 END AS trained_n FROM c WHERE n >= 30 AND (label >= 7 OR label * 5 >= 20)""")
def refit_due(t):
    counts = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    report = counts.filter("label < 7").select("label", (F.col("n") - F.col("label") * 5).alias("trained_n"))
    return M.refit_due(counts, report, "label")


_UNSEEN = 99  # a target that has candidates and no model


@query("M5", f"""
WITH d AS (SELECT {_UNSEEN} AS target, vec_id, row_number() OVER (ORDER BY md5(vec_id || '|42'), vec_id) AS place FROM embeddings),
  k AS (SELECT target, unnest(range(1, least(n, 10) + 1)) AS place FROM ({_TARGETS}))
SELECT target, CAST(place AS INTEGER) AS place, vec_id AS drawn, FALSE AS falling FROM d WHERE place <= 10
UNION ALL SELECT target, CAST(place AS INTEGER), NULL, TRUE FROM k""")
def prescreen(t):
    """Places and, where there is no model, the rows drawn; predictions, which SQL cannot make, must fall from place to place."""
    rows = model_rows(t)
    models, _ = M.train_targets(rows, "target", "score", "vec_id")
    asked = rows.unionByName(rows.withColumn("target", F.lit(_UNSEEN)))
    best = M.prescreen(asked, models, "target", "vec_id", 10)
    before = F.lag("predicted", 1, float("inf")).over(Window.partitionBy("target").orderBy("place"))
    return best.select("target", "place", F.when(F.col("predicted").isNull(), F.col("vec_id")).alias("drawn"),
                       F.coalesce(F.col("predicted") <= before, F.lit(False)).alias("falling"))


@query("M6", f"""
SELECT target, CAST(unnest(range(1, 11)) AS INTEGER) AS place, TRUE AS of_pool FROM ({_TARGETS}) WHERE n >= 30""")
def prescreen_pool(t):
    """Every target whose model is trusted meets its own pool of one shared library of all vectors."""
    models, report = M.train_targets(model_rows(t), "target", "score", "vec_id")
    shared = library(t)
    best = M.prescreen_pool(shared, models, report, "target", "vec_id")
    pool = M.pool_draws(shared, report.select("target"), "target", "vec_id").withColumn("of_pool", F.lit(True))
    return best.join(pool, ["target", "vec_id"], "left").select("target", "place", F.coalesce("of_pool", F.lit(False)).alias("of_pool"))


@query("K4", f"SELECT target, n AS compared, n AS equal FROM ({_TARGETS}) WHERE n >= 30")
def saved_models(t):
    """Predictions of all rows by the models as trained and as saved and loaded."""
    rows = model_rows(t)
    models, _ = M.train_targets(rows, "target", "score", "vec_id")
    root = fresh_dir(t.spark, "models")
    M.save_models(models, root, "target")
    fresh = M.with_predictions(rows, models, "target").select("target", "vec_id", F.col("predicted").alias("fresh"))
    again = M.with_predictions(rows, M.load_models(t.spark, root), "target").select("target", "vec_id", "predicted")
    return fresh.join(again, ["target", "vec_id"]).filter("predicted is not null").groupBy("target").agg(
        F.count("*").alias("compared"), F.count(F.when(F.col("fresh") == F.col("predicted"), 1)).alias("equal"))


@query("M7", """
WITH c AS (SELECT label, count(*) AS n, round(avg(embedding[1]), 3) AS r2 FROM embeddings GROUP BY 1)
SELECT label, n, CASE WHEN n < 45 THEN 'learning' WHEN label = 3 THEN 'failed' WHEN label % 2 = 0 AND n > label * 10 THEN 'improved' ELSE 'ready' END AS status FROM c""")
def model_report(t):
    counts = t.embeddings.groupBy("label").agg(F.count("*").alias("n")).withColumn(
        "r2", F.when(F.col("label") != 3, F.col("n") / 1000))
    previous = counts.filter("label % 2 = 0").select("label", (F.col("label") / 100).alias("r2"))
    return M.model_report(counts, previous, "label", least=45).select("label", "n", "status")


# --- hooks ---------------------------------------------------------------------------------------------

@query("X1", """
SELECT o_custkey, o_orderkey, CASE s WHEN 0 THEN 'big' ELSE 'any' END AS method FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS r FROM (
    SELECT o_custkey, o_orderkey, 0 AS s FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders)) WHERE r = 1""")
def pick_with(t):
    orders = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    big = lambda c: orders.filter("o_totalprice > 400000").join(c, "o_custkey", "left_semi").drop("o_totalprice")
    everything = lambda c: orders.join(c, "o_custkey", "left_semi").drop("o_totalprice")
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return H.pick_with(customers, {"big": big, "any": everything}, "o_custkey", ["o_orderkey"])


@query("X2", "SELECT event_id, value / 1000 AS score FROM events")
def score_with(t):
    return H.score_with(t.events.select("event_id", "value"), lambda rows: rows["value"] / 1000).select("event_id", "score")


@query("X3", "SELECT doc_id, length(text) AS n_chars, len(string_split(text, ' ')) AS n_words FROM documents")
def featurise_with(t):
    def shape(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [len(x), len(x.split(" "))])
    out = H.featurise_with(t.documents.select("doc_id", "text"), "text", shape)
    return out.select("doc_id", F.get("fp", F.lit(0)).cast("long").alias("n_chars"), F.get("fp", F.lit(1)).cast("long").alias("n_words"))


@query("X4", "SELECT p_partkey, round(p_retailprice / (p_size + 1), 6) AS rank_score FROM part ORDER BY rank_score DESC, p_partkey LIMIT 25")
def rank_with(t):
    return H.rank_with(t.part.select("p_partkey", "p_size", "p_retailprice"),
                       F.round(F.col("p_retailprice") / (F.col("p_size") + 1), 6), "p_partkey", 25).select("p_partkey", "rank_score")


# --- flows ---------------------------------------------------------------------------------------------

_DRAWN = """WITH RECURSIVE placed AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS pos, count(*) OVER () AS size FROM documents),
  h AS (SELECT i, (SELECT sum(((i + 1) // p) % 2 / (p::DOUBLE * 2)) FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128]::BIGINT[]) AS p)) AS u FROM range(200) r(i)),
  drawn AS (SELECT i, doc_id, text, substr(md5(text), 1, 16) AS key FROM h JOIN placed ON pos = CAST(floor(u * size) AS BIGINT) + 1),
  one AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY key ORDER BY i) = 1),
  fresh AS (SELECT i AS doc_id, doc_id AS lang, i AS n_chars, text, key FROM one WHERE key IS NULL OR key NOT IN (SELECT substr(md5(text), 1, 16) FROM benchmark WHERE text IS NOT NULL)),
  s AS"""


@query("T9", _DOCS.format(order="doc_id", t=0.85).replace("WITH RECURSIVE s AS", _DRAWN).replace("AS g FROM documents)", "AS g FROM fresh)")
       + _STEPS.format(order="doc_id", rows="d") + """,
  v AS (SELECT kept.doc_id AS draw, d.lang AS doc_id, key, length(text) / 100 AS ha, d.n / 20 / 167.0 AS p FROM kept JOIN d USING (doc_id) JOIN fresh USING (doc_id))
SELECT draw, doc_id, key, round(CASE WHEN ha BETWEEN 15 AND 55 THEN 0.4 * exp(-abs(ha / 30.0 - 1) / 0.3) + 0.3 + 0.2
  + 0.1 * least(1.0, CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0 END / 0.5) ELSE 0 END, 6) AS proxy_score FROM v""")
def sweep(t):
    """Documents as a library: quasi-random draw, gates, proxy score by length."""
    library = t.documents.select("doc_id", "text")
    seen = t.benchmark.select(content_key("text").alias("key"))
    score = proxy_score(F.length("text") / 100, F.lit(3.0), F.size("fp") / 20)
    out = SW.sweep(library, seen, "text", "fp", score, ["doc_id"], 0, 200, sets=document_set())
    return out.select("draw", "doc_id", "key", F.round("proxy_score", 6).alias("proxy_score"))


@query("J10", """
WITH b AS (SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50)
SELECT p_partkey, i - 1 AS rgroup_idx, p_name || d[i] AS p_name, p_retailprice AS parent_score FROM b,
 (SELECT ['', 'C', 'OC', 'F', 'Cl', 'CC', 'C(C)C', 'C(=O)O', 'C(=O)N', 'N', 'S(=O)(=O)N', 'CF', 'OCC', 'C#N', 'C(F)(F)F'] AS d), range(1, 16) r(i)""")
def mutate_elite(t):
    pool = t.part.select("p_partkey", "p_name", "p_retailprice")
    return SW.mutate_elite(pool, "p_retailprice", "p_partkey", "p_name").select("p_partkey", "rgroup_idx", "p_name", "parent_score")


