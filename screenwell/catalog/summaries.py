"""Aggregates, windows, top-k reports and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import epoch_day, seed_score, unix_seconds
from ..operators import aggregates as A
from ..operators import selection as S
from ..operators import windows as W
from ..plans import monitoring
from ..streaming.streams import liveness as is_live
from .base import query
from .columns import PROXY_SQL, SOURCE_SQL, proxy_of_parts, source_of


@query("A1", """
SELECT coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'general') AS family, count(*) AS n,
  round(avg(value), 6) AS mean_score, max(value) AS best_score FROM events GROUP BY 1""")
def family_summary(t):
    rows = t.events.withColumn("family", F.when(F.col("event_type") != "error", F.col("event_type")))
    return A.family_summary(rows, "family", "value").withColumn("mean_score", F.round("mean_score", 6))


@query("A2", """
SELECT count(*) AS workers, CAST(sum(n) AS BIGINT) AS molecules, round(sum(v), 2) AS earned, round(sum(p), 2) AS power
FROM (SELECT user_id, count(*) AS n, sum(value) AS v, max(value) AS p FROM events GROUP BY 1)""")
def fleet_totals(t):
    workers = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.max("value").alias("p"))
    return (A.fleet_totals(workers, "n", "v", "p").withColumn("earned", F.round("earned", 2))
            .withColumn("power", F.round("power", 2)))


@query("A3", """
SELECT (SELECT CASE WHEN count(CASE WHEN c_acctbal < -900 THEN 1 END) > 0 THEN count(CASE WHEN c_acctbal < -900 THEN 1 END)
          ELSE count(CASE WHEN c_nationkey > 0 THEN 1 END) END FROM customer) AS submitters,
       (SELECT CAST(sum(c_nationkey) AS BIGINT) FROM customer) AS screened, (SELECT CAST(sum(o_custkey) AS BIGINT) FROM orders) AS hits""")
def network_totals(t):
    return A.network_totals(t.customer, F.col("c_acctbal") < -900, "c_nationkey", t.orders, "o_custkey")


@query("A4", """
SELECT count(DISTINCT user_id) AS active FROM events WHERE epoch_us(ts) / 400000.0 >= 4264272000 - 216000""")
def active_submitters(t):
    rows = t.events.select("user_id", (unix_seconds("ts") * 2.5).alias("slot"))
    return A.active_submitters(rows, "user_id", "slot", 4_264_272_000)


@query("A6", """
SELECT event_type, count(*) AS attempts, count(CASE WHEN value > 20 THEN 1 END) AS passes, count(CASE WHEN value > 100 THEN 1 END) AS accepted,
  round(count(CASE WHEN value > 20 THEN 1 END) * 100.0 / count(*), 2) AS pass_rate,
  round(count(CASE WHEN value > 100 THEN 1 END) * 100.0 / count(CASE WHEN value > 20 THEN 1 END), 2) AS accept_rate FROM events GROUP BY 1""")
def rates(t):
    return A.rates(t.events, "event_type", F.col("value") > 20, F.col("value") > 100)


@query("A9", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS targets FROM orders GROUP BY 1")
def contributed(t):
    return A.contributed(t.orders, "o_custkey", "o_orderpriority")


_RANKED = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


@query("A10", _RANKED + """
SELECT event_type, max(n) AS n, max(CASE WHEN n >= 10 AND k = greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN value END) AS threshold
FROM r GROUP BY 1""")
def decile_threshold(t):
    return A.decile_threshold(t.events, "event_type", "value")


@query("A10", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(n) AS n, max(CASE WHEN n >= 10 AND k = greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN value END) AS threshold
FROM r GROUP BY 1""")
def user_decile_threshold(t):
    return A.decile_threshold(t.events, "user_id", "value")


@query("A11", f"""
WITH e AS (SELECT event_id, user_id, value, source FROM (SELECT *, {SOURCE_SQL} AS source FROM events) WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n
  FROM e WHERE source IS NULL OR source NOT IN ('ref', 'reference')),
q AS (SELECT user_id, max(n) AS n, max(CASE WHEN k = greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN value END) AS thr FROM r GROUP BY 1)
SELECT event_id, n < 10 OR value <= thr AS qualifies FROM e JOIN q ON e.user_id IS NOT DISTINCT FROM q.user_id
WHERE source IN ('zinc15', 'zinc15-fallback', 'mutant', 'generate', 'pulse')""")
def discovery_gate(t):
    rows = t.events.withColumn("source", source_of())
    return A.discovery_gate(rows, "user_id", "value", "source").select("event_id", "qualifies")


@query("A16", """
SELECT count(CASE WHEN s = 'ready' THEN 1 END) AS n_ready, count(CASE WHEN s = 'learning' THEN 1 END) AS n_learning,
  count(CASE WHEN s = 'failed' THEN 1 END) AS n_failed, count(*) AS n_total
FROM (SELECT CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'ready' ELSE 'learning' END AS s FROM labels)""")
def report_rollup(t):
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "ready").otherwise("learning")
    return A.report_rollup(t.labels.select(status.alias("status")))


@query("A17", """
WITH s AS (SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS have,
  p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2) AS bad FROM part)
SELECT count(*) AS wanted, count(CASE WHEN have THEN 1 END) AS cached, count(CASE WHEN NOT have AND bad THEN 1 END) AS failed,
  count(CASE WHEN NOT have AND NOT bad THEN 1 END) AS missing FROM s""")
def coverage(t):
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return A.coverage(t.part, lines.filter("l_quantity > 49"), "p_partkey", lines.filter("l_quantity < 2"))


@query("A18", """
SELECT event_type, count(*) AS n, count(*) % 50 AS since_refit, round((count(*) % 50) * 100.0 / 50, 2) AS percent, 50 - count(*) % 50 AS remaining
FROM events GROUP BY 1""")
def refit_progress(t):
    return A.refit_progress(t.events, "event_type").withColumn("remaining", F.col("remaining").cast("long"))


@query("A19", """
SELECT user_id, count(*) AS n, round(count(*) / greatest(0.001, (max(s) - min(s)) / 3600) / 1000, 6) AS khs,
  CASE WHEN max(s) > min(s) THEN round(count(*) / (max(s) - min(s)), 6) END AS per_second
FROM (SELECT user_id, epoch_us(ts) / 1000000.0 AS s FROM events) GROUP BY 1""")
def throughput(t):
    return A.throughput(t.events.select("user_id", unix_seconds("ts").alias("s")), "user_id", "s")


@query("A20", "SELECT user_id, max(value) AS best, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def history_stats(t):
    return A.history_stats(t.events, "user_id", "value").withColumn("mean", F.round("mean", 6))


# --- windows ------------------------------------------------------------------------------------

@query("A5", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_per_key(t):
    return W.best_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query("W1", "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text")
def dedup_first(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("key"))
    return W.dedup_first(rows, "key", "doc_id")


@query("W3", """
SELECT o_orderkey, row_number() OVER w AS screened, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS earned
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def running_totals(t):
    out = W.running_totals(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_orderkey", "screened", F.round("earned", 2).alias("earned"))


@query("W3", """
SELECT o_orderkey, row_number() OVER w AS screened, CAST(sum(o_custkey) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS earned
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def network_running_totals(t):
    from ..operators.ordering import Running, running
    specs = [Running("screened", "count"), Running("earned", "sum", "o_custkey")]
    return running(t.orders, specs, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "screened", "earned")


@query("W4", """
WITH d AS (SELECT epoch_us(ts) // 3600000000 AS batch, count(*) AS requested, count(CASE WHEN value > 30 THEN 1 END) AS delivered FROM events GROUP BY 1)
SELECT batch, requested, delivered, CAST(count(*) OVER w AS INTEGER) AS window_batches, round(sum(delivered) OVER w / sum(requested) OVER w, 3) AS rolling_rate
FROM d WINDOW w AS (ORDER BY batch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_yield(t):
    batches = (t.events.groupBy(F.floor(unix_seconds("ts") / 3600).alias("batch"))
               .agg(F.count("*").alias("requested"), F.count(F.when(F.col("value") > 30, 1)).alias("delivered")))
    return W.rolling_yield(batches, "batch", "delivered", "requested")


@query("W5", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20""")
def last_n(t):
    return W.last_n(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts desc", "event_id desc"], 20).drop("ts")


@query("W5", """
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5000""")
def ring_buffer(t):
    rows = t.events.select("event_type", "event_id", "ts")
    return W.last_n(rows, "event_type", ["ts desc", "event_id desc"], 5000).drop("ts")


_GATE = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT x.event_id, x.n, count(y.event_id) AS below FROM e x LEFT JOIN e y ON y.{key} = x.{key} AND y.n < x.n AND y.value < x.value GROUP BY 1, 2)
SELECT event_id, n AS n_so_far, below AS n_below, n < 10 OR below < greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS qualifies FROM b"""


@query("W7", _GATE.format(key="event_type"))
def running_quantile_gate(t):
    rows = W.running_quantile_gate(t.events, "event_type", ["ts", "event_id"], "value", "event_id")
    return rows.select("event_id", "n_so_far", "n_below", "qualifies")


@query("W7", _GATE.format(key="user_id"))
def user_quantile_gate(t):
    rows = W.running_quantile_gate(t.events, "user_id", ["ts", "event_id"], "value", "event_id")
    return rows.select("event_id", "n_so_far", "n_below", "qualifies")


@query("W8", """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS micros FROM events),
  a AS (SELECT user_id, min(micros) AS micros FROM e GROUP BY 1
        UNION ALL
        SELECT a.user_id, min(e.micros) FROM a JOIN e ON e.user_id = a.user_id AND e.micros >= a.micros + 14400000000 GROUP BY 1)
SELECT user_id, event_id, micros FROM a JOIN (SELECT user_id, epoch_us(ts) AS micros, min(event_id) AS event_id FROM events GROUP BY 1, 2) USING (user_id, micros)""")
def throttle(t):
    rows = t.events.select("user_id", "event_id", F.unix_micros("ts").alias("micros"))
    return W.throttle(rows, "user_id", "micros", 4 * 3600 * 1_000_000, "event_id")


# --- top-k and selection ---------------------------------------------------------------------------

@query("T1", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS score FROM orders
ORDER BY coalesce(score, -1) DESC, o_orderkey LIMIT 100""")
def top_n(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score"))
    return S.top_n(rows, "score", "o_orderkey", 100, null_as=-1.0)


@query("T2", """
SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, event_type FROM events
ORDER BY ts DESC, event_id LIMIT 50""")
def feed(t):
    from ..functions.columns import iso_ts
    return monitoring.feed(t.events.withColumn("s", unix_seconds("ts")), "s", "event_id", 50,
                           ["event_id", iso_ts("s").alias("at"), "event_type"])


@query("T3", f"""
WITH f AS (SELECT p_name, arg_min(proxy, p_partkey) AS proxy, min(p_partkey) AS p_partkey FROM ({PROXY_SQL})
  WHERE proxy > 0 AND p_type <> 'LARGE' AND p_name NOT IN (SELECT p_name FROM part WHERE p_retailprice > 999.5) GROUP BY 1)
SELECT p_partkey, p_name, proxy FROM f ORDER BY proxy DESC, p_partkey LIMIT 20""")
def next_candidates(t):
    rows = proxy_of_parts(t).withColumn("family", F.when(F.col("p_type") == "LARGE", "kinase").otherwise("cytokine"))
    done = t.part.filter("p_retailprice > 999.5")
    return S.next_candidates(rows, "p_name", "proxy", "p_partkey", 20, done, "family", "cytokine").select(
        "p_partkey", "p_name", "proxy")


@query("T4", """
WITH b AS (SELECT event_id, value FROM events WHERE value > 0 ORDER BY value DESC, event_id LIMIT 50)
SELECT *, (SELECT CASE WHEN count(*) >= 50 THEN min(value) ELSE 0 END FROM b) AS entry_threshold FROM b""")
def elite_pool(t):
    return S.elite_pool(t.events.select("event_id", "value"), "value", "event_id", 50)


@query("T8", "SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || '|42'), p_partkey LIMIT 500")
def sample_n(t):
    return S.sample_n(t.part.select("p_partkey", "p_name"), "p_partkey", 500)


_HALTON_DRAW = """(SELECT sum(((i + 1) // CAST(pow(2, k) AS BIGINT)) % 2 / pow(2, k + 1)) FROM range(0, 40) r(k))"""


@query("T9", f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part),
  d AS (SELECT i AS draw, CAST(floor({_HALTON_DRAW} * (SELECT count(*) FROM part)) AS BIGINT) AS pos FROM range(100, 1100) t(i))
SELECT draw, p_partkey, p_name FROM d JOIN p USING (pos)""")
def halton_sample(t):
    return S.halton_sample(t.part.select("p_partkey", "p_name"), "p_partkey", 1000, start=100)


def _sources(t, key):
    rows = t.events.select(key, "event_id", "value", "event_type")
    return [(m, rows.filter(F.col("event_type") == e).drop("event_type"))
            for m, e in (("pulse", "click"), ("generate", "purchase"), ("model", "signup"), ("random", "view"))]


_METHODS = "CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END"


@query("T10", f"""
SELECT user_id, event_id, value, ['pulse', 'generate', 'model', 'random'][m + 1] AS method FROM (
  SELECT *, {_METHODS} AS m, row_number() OVER (PARTITION BY user_id ORDER BY {_METHODS}, value DESC, event_id) AS r
  FROM events WHERE event_type <> 'error') WHERE r = 1""")
def pick_candidates(t):
    return S.pick_candidates(_sources(t, "user_id"), "user_id", ["value desc", "event_id"])


@query("T11", """
SELECT p_partkey, CASE WHEN p_size < 40 THEN p_size // 5 END AS tier FROM part WHERE coalesce(CASE WHEN p_size < 40 THEN p_size // 5 END, 9) <= 6
ORDER BY coalesce(CASE WHEN p_size < 40 THEN p_size // 5 END, 9), p_partkey LIMIT 200""")
def prioritise(t):
    tier = F.when(F.col("p_size") < 40, F.floor(F.col("p_size") / 5).cast("int"))
    return S.prioritise(t.part.select("p_partkey", tier.alias("tier")), "tier", "p_partkey", tier_max=6, n=200)


@query("T12", """
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
  ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS r FROM lineitem) WHERE r <= 10""")
def limit_per_key(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.limit_per_key(rows, "l_partkey", ["l_orderkey", "l_linenumber", "l_extendedprice"], 10)


@query("T13", """
SELECT bucket, round(max(value), 4) AS best_score, arg_max(event_type, value) AS target,
  strftime(make_timestamp(arg_max(us, value) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_iso
FROM (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 21600000000 AS bucket FROM events WHERE epoch_us(ts) > 1706659200000000 - 1296000000000)
GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def score_history(t):
    rows = t.events.select(unix_seconds("ts").alias("s"), "value", "event_type")
    return monitoring.score_history(rows, "s", "value", "event_type", 1_706_659_200.0, span=1_296_000.0, bucket=21_600.0)


@query("R6", """
SELECT user_id, max(epoch_us(ts)) / 1000000.0 AS last_seen, 1706572800 - max(epoch_us(ts)) / 1000000.0 <= 86400 AS alive FROM events GROUP BY 1""")
def liveness(t):
    rows = t.events.select("user_id", unix_seconds("ts").alias("s"))
    return is_live(rows, "user_id", "s", 1_706_572_800.0, gap=86_400.0)


# --- set operations -----------------------------------------------------------------------------------

@query("U1", """
WITH u AS (SELECT md5(text) AS key, doc_id, n_chars, lang, CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS p FROM documents),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, doc_id) AS r FROM u) WHERE r = 1)
SELECT key, doc_id, n_chars, ['es', 'fr', 'rest'][p + 1] AS method FROM f ORDER BY n_chars DESC, key LIMIT 100""")
def merge_candidates(t):
    d = t.documents.select(F.md5("text").alias("key"), "doc_id", "n_chars", "lang")
    parts = [("es", d.filter("lang = 'es'")), ("fr", d.filter("lang = 'fr'")), ("rest", d.filter("lang NOT IN ('es', 'fr')"))]
    return S.merge_candidates([(n, x.drop("lang")) for n, x in parts], "key", "n_chars", "doc_id", 100)


@query("U2", """
WITH b AS (SELECT o_custkey FROM (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ORDER BY m DESC, o_custkey LIMIT 50)
SELECT o_custkey, 'parent' AS origin FROM b
UNION ALL SELECT DISTINCT o_custkey, 'seed' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM b)""")
def parent_pool(t):
    best = S.top_n(t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")), "m", "o_custkey", 50)
    seeds = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return S.parent_pool(best.select("o_custkey"), seeds, "o_custkey")


@query("U3", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def minus_submitted(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return S.minus_submitted(t.orders.select("o_orderkey"), done, "o_orderkey")


@query("U4", """
WITH s AS (SELECT lang, doc_id, CASE doc_id % 3 WHEN 0 THEN 'query' WHEN 1 THEN '101' ELSE CAST(doc_id AS VARCHAR) END AS header FROM documents WHERE n_chars >= 2000),
  f AS (SELECT lang, min(doc_id) AS first FROM s WHERE header NOT IN ('query', '101') GROUP BY 1)
SELECT uniprot_id, row_number() OVER (PARTITION BY uniprot_id ORDER BY side, doc_id) - 1 AS pos, header,
       CASE side WHEN 0 THEN 'primary' ELSE 'secondary' END AS origin
FROM (SELECT lang AS uniprot_id, doc_id, CAST(doc_id AS VARCHAR) AS header, 0 AS side FROM documents WHERE n_chars < 2000
      UNION ALL SELECT lang, doc_id, header, 1 FROM s JOIN f USING (lang) WHERE doc_id >= first)""")
def merge_msa(t):
    from ..operators.ordering import number_rows
    from ..sources.files import merge_msa as merge

    def side(rows, header):
        placed = number_rows(rows.select(F.col("lang").alias("uniprot_id"), "doc_id"), ["doc_id"], ["uniprot_id"], "p")
        return placed.select("uniprot_id", (F.col("p") - 1).cast("int").alias("pos"), header.alias("header"))
    own = F.col("doc_id").cast("string")
    third = F.col("doc_id") % 3
    out = merge(side(t.documents.filter("n_chars < 2000"), own),
                side(t.documents.filter("n_chars >= 2000"), F.when(third == 0, "query").when(third == 1, "101").otherwise(own)))
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("U5", """
SELECT DISTINCT fragment FROM (SELECT unnest(string_split(text, ' ')) AS fragment FROM (SELECT text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10))
WHERE length(fragment) >= 3""")
def fragment_pool(t):
    rows = t.documents.select("doc_id", "n_chars", F.split("text", " ").alias("fragments"))
    return S.fragment_pool(rows, "n_chars", "doc_id", "fragments")


@query("P9", """
SELECT l_partkey, round(max(round(coalesce(CASE WHEN l_returnflag <> 'R' THEN l_discount * 10 END, 0.5) * least(l_quantity / 9.0, 1.0), 6)), 6) AS best
FROM lineitem GROUP BY 1""")
def best_seed(t):
    score = seed_score(F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 10), "l_quantity")
    return t.lineitem.groupBy("l_partkey").agg(F.max(F.round(score, 6)).alias("best"))


@query("P17", "SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1")
def rows_per_day(t):
    return t.events.groupBy(epoch_day(unix_seconds("ts")).alias("day")).agg(F.count("*").alias("n"))
