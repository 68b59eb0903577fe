"""Exact joins, ledger joins and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import to_affinity, unix_seconds
from ..operators import joins as J
from ..operators import ledger as L
from ..plans import best_hits
from .base import query


def _thresholds(t):
    """Target dimension of the event log: one row per event type."""
    return (t.events.select("event_type").distinct()
            .withColumn("target_score_threshold", -F.length("event_type") * 200.0))


_JUDGED = """
WITH s AS (SELECT event_id, ts, user_id, event_type, value, round(value * -30.0, 3) AS affinity,
             last_value(CASE WHEN value < 5 THEN round(value * -30.0, 3) END IGNORE NULLS)
               OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ref,
             -length(event_type) * 200.0 AS own FROM events),
     j AS (SELECT *, CAST(coalesce(ref + 0.5, own) AS DOUBLE) AS effective_threshold FROM s)"""


@query("J3", _JUDGED + """
SELECT event_id, affinity, round(effective_threshold, 6) AS effective_threshold, affinity <= effective_threshold AS hit FROM j""")
def effective_threshold(t):
    judged = best_hits.judge_scores(t.events, _thresholds(t), "event_type", "value", ["ts", "event_id"],
                                    F.col("value") < 5)
    return judged.select("event_id", "affinity", F.round("effective_threshold", 6).alias("effective_threshold"), "hit")


@query("A5", _JUDGED + """
SELECT event_type, event_id, user_id, value, affinity FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) AS r FROM j
  WHERE affinity <= effective_threshold) WHERE r = 1""")
def best_hit_per_target(t):
    best = best_hits.best_hit_per_target(t.events, _thresholds(t), "event_type", "value", ["ts", "event_id"],
                                         F.col("value") < 5)
    return best.select("event_type", "event_id", "user_id", "value", "affinity")


@query("J3", """
SELECT event_id, last_value(CASE WHEN value < 5 THEN value END IGNORE NULLS)
  OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ref FROM events""")
def last_reference_of_period(t):
    from ..operators.ordering import last_known
    rows = t.events.select("event_id", "event_type", "ts", F.floor(unix_seconds("ts") / 86400).alias("period"),
                           F.when(F.col("value") < 5, F.col("value")).alias("r"))
    return last_known(rows, "r", ["ts", "event_id"], ["event_type", "period"], "ref").select("event_id", "ref")


@query("J1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, p_brand, p_size
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def enrich(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return J.enrich(rows, part, "l_partkey")


@query("J1", """
SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def salted_join(t):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return J.salted_join(rows, orders, "l_orderkey", "inner", salts=4)


@query("J2", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)")
def registered(t):
    members = t.customer.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("o_custkey"))
    return J.registered(t.orders.select("o_orderkey", "o_custkey"), members, "o_custkey").select("o_orderkey")


@query("J2", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)")
def unregistered(t):
    members = t.customer.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("o_custkey"))
    return J.unregistered(t.orders.select("o_orderkey", "o_custkey"), members, "o_custkey").select("o_orderkey")


@query("J4", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) AND text NOT IN (SELECT text FROM conversations)")
def anti_seen(t):
    seen = t.benchmark.select("text").unionAll(t.conversations.select("text"))
    key = F.md5("text").alias("key")
    return J.anti_seen(t.documents.select("doc_id", key), seen.select(key), "key").select("doc_id")


@query("J8", """
SELECT c.o_orderkey, c.o_totalprice, p.o_totalprice AS parent_score FROM orders c
JOIN orders p ON p.o_orderkey = c.o_orderkey // 2 WHERE c.o_totalprice > p.o_totalprice""")
def improving(t):
    children = t.orders.select("o_orderkey", F.floor(F.col("o_orderkey") / 2).alias("parent"), "o_totalprice")
    return J.improving(children, t.orders, "parent", "o_orderkey", "o_totalprice", "o_totalprice").select(
        "o_orderkey", "o_totalprice", "parent_score")


_VOTES = """
WITH v AS (SELECT l_orderkey, l_suppkey, l_extendedprice * 4 AS rescored FROM lineitem),
     n AS (SELECT o_orderkey, count(l_suppkey) AS n_validations,
             count(DISTINCT CASE WHEN abs(rescored - o_totalprice) <= 0.4 * abs(o_totalprice) THEN l_suppkey END) AS n_confirming
           FROM orders LEFT JOIN v ON l_orderkey = o_orderkey GROUP BY 1)"""


def votes(t):
    """Order lines as three-fold rescored validations of an order's claimed total."""
    subs = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    vals = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey",
                             (F.col("l_extendedprice") * 4).alias("rescored"))
    return J.consensus(subs, vals, "o_orderkey", "o_totalprice", "rescored", "l_suppkey", tolerance=0.4)


@query("J9", _VOTES + "SELECT *, n_confirming >= 2 AS confirmed FROM n")
def consensus(t):
    return votes(t).select("o_orderkey", "n_validations", "n_confirming", "confirmed")


@query("J10", """
SELECT c_custkey, i - 1 AS rgroup_idx, d[i] AS rgroup FROM customer,
 (SELECT ['', 'C', 'OC', 'F', 'Cl', 'CC', 'C(C)C', 'C(=O)O', 'C(=O)N', 'N', 'S(=O)(=O)N', 'CF', 'OCC', 'C#N', 'C(F)(F)F'] AS d), range(1, 16) r(i)""")
def enumerate_decorations(t):
    return J.enumerate_decorations(t.customer.select("c_custkey"))


@query("J11", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def restrict_to(t):
    return J.restrict_to(t.documents.select("doc_id", "lang"), t.labels.filter("quality = 1"), "doc_id")


@query("J12", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
ORDER BY c_acctbal DESC, c_custkey LIMIT 2""")
def unvisited(t):
    fact = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.unvisited(t.customer, fact, "c_custkey", ["c_acctbal desc", "c_custkey"]).select("c_custkey")


@query("J13", """
WITH e AS (SELECT p_partkey AS epoch, p_partkey * 1000 AS start, 100 + p_size * 18 AS len FROM part)
SELECT o_orderkey, epoch FROM orders LEFT JOIN e ON o_orderkey * 17 >= start AND o_orderkey * 17 < start + len""")
def assign_epoch(t):
    epochs = t.part.select(F.col("p_partkey").alias("epoch"), (F.col("p_partkey") * 1000).alias("start"),
                           (F.col("p_size") * 18 + 100).alias("len"))
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") * 17).alias("slot"))
    return J.assign_epoch(rows, epochs, "slot", "start", "len", "epoch", "o_orderkey").select("o_orderkey", "epoch")


@query("J13", "SELECT event_id, CASE WHEN event_id * 37 >= 1000 THEN (event_id * 37 - 1000) // 216000 END AS epoch FROM events")
def fixed_epoch(t):
    rows = t.events.select("event_id", (F.col("event_id") * 37).alias("slot"))
    return rows.select("event_id", J.fixed_epoch("slot", 1000, 216_000).alias("epoch"))


@query("J14", """
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS is_fulfilled FROM orders""")
def fulfilment(t):
    done = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.fulfilment(t.orders.select("o_orderkey"), done, "o_orderkey")


# --- ledger -----------------------------------------------------------------------------------

_STATUS = """CASE WHEN n_validations = 0 THEN 'Pending' WHEN n_confirming >= 2 THEN 'Confirmed'
  WHEN n_validations >= 3 THEN 'Rejected' ELSE 'Validating' END"""


@query("Q2", _VOTES + f"SELECT o_orderkey, {_STATUS} AS status FROM n")
def result_status(t):
    return L.result_status(votes(t)).select("o_orderkey", "status")


@query("Q3", _VOTES + f"""SELECT o_orderkey FROM n WHERE {_STATUS} = 'Confirmed'
  AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def payable(t):
    paid = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    return L.payable(L.result_status(votes(t)), paid, "o_orderkey").select("o_orderkey")


@query("Q1", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 5000 - l_extendedprice AS affinity, l_shipdate,
             p_size > 10 AS active, CASE l_returnflag WHEN 'A' THEN 'Pending' WHEN 'N' THEN 'Validating' ELSE 'Confirmed' END AS status,
             s_acctbal IS NOT NULL AND s_acctbal > 0 AS known,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS nth
           FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT violation, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM (
  SELECT l_orderkey, 'AffinityNotNegative' AS violation FROM s WHERE NOT affinity < 0
  UNION ALL SELECT l_orderkey, 'TargetInactive' FROM s WHERE NOT coalesce(active, false)
  UNION ALL SELECT l_orderkey, 'AlreadyFinalised' FROM s WHERE status = 'Confirmed'
  UNION ALL SELECT l_orderkey, 'DuplicateInEpoch' FROM s WHERE nth > 1
  UNION ALL SELECT l_orderkey, 'UnknownValidator' FROM s WHERE NOT known) GROUP BY 1""")
def violations(t):
    from ..operators.ordering import number_rows
    rows = t.lineitem.withColumn("affinity", 5000 - F.col("l_extendedprice")).withColumn(
        "status", F.when(F.col("l_returnflag") == "A", "Pending").when(F.col("l_returnflag") == "N", "Validating")
        .otherwise("Confirmed"))
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 10).alias("active"))
    known = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("known"))
    rows = J.enrich(J.enrich(rows, part, "l_partkey"), known, "l_suppkey")
    rows = number_rows(rows, ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_orderkey", "l_linenumber"], "nth")
    rules = L.submission_rules("affinity", "active", "status", "known", "nth")
    return (L.violations(rows, rules, ["l_orderkey", "l_linenumber"]).groupBy("violation")
            .agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum")))


@query("Q4", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(l_quantity / 5, 3) AS pchembl FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_quantity / 5 >= 6""")
def eligible_activities(t):
    text = F.when(F.col("l_returnflag") == "N", "none").otherwise((F.col("l_quantity") / 5).cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "Ki").when(F.col("l_returnflag") == "R", "IC50").otherwise("Ki")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", text.alias("pchembl"),
                             kind.alias("kind"), F.when(F.col("l_linestatus") == "F", "B").otherwise("F").alias("assay"))
    return L.eligible_activities(rows, "pchembl", "kind", "assay").drop("kind", "assay")


@query("Q5", """
SELECT p_brand, p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY
  CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, p_partkey) AS r FROM part) WHERE r = 1""")
def resolve_target(t):
    return L.resolve_target(t.part, "p_brand", "p_type", ["p_partkey"], preferred="PROMO").select("p_brand", "p_partkey", "p_type")


@query("Q6", """
SELECT c_custkey, count(o_orderkey) AS cached_rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY 1 HAVING count(o_orderkey) < 8""")
def needs_refresh(t):
    cached = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return L.needs_refresh(t.customer, cached, "c_custkey", least=8)


@query("Q7", """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'registered'
  WHEN (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'P') < 20 THEN 'free'
  WHEN c_acctbal * 10000 >= CASE WHEN c_mktsegment = 'BUILDING' THEN 100000000 ELSE 33000000 END THEN 'funded'
  ELSE 'insufficient' END AS eligibility FROM customer""")
def eligibility(t):
    members = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return L.eligibility(t.customer, members, "c_custkey", F.col("c_acctbal") * 10_000,
                         F.col("c_mktsegment") == "BUILDING").select("c_custkey", "eligibility")


_WEEK = "epoch_us(o_orderdate) // 604800000000"
_LEADERS = f"""
WITH w AS (SELECT {_WEEK} AS week, o_orderpriority AS target, o_custkey, -o_totalprice AS affinity, o_orderkey FROM orders),
     l AS (SELECT week, target, o_custkey AS leader, affinity AS leader_affinity FROM (
       SELECT *, row_number() OVER (PARTITION BY week, target ORDER BY affinity, o_orderkey) AS r FROM w) WHERE r = 1)"""


def leaders(t):
    week = F.floor(F.unix_seconds("o_orderdate") / 604_800)
    rows = t.orders.select(week.alias("week"), F.col("o_orderpriority").alias("target"), "o_custkey",
                           (-F.col("o_totalprice")).alias("affinity"), "o_orderkey")
    return L.weekly_leaders(rows, "week", "target", "o_custkey", "affinity", ["o_orderkey"])


@query("A12", _LEADERS + "SELECT * FROM l")
def weekly_leaders(t):
    return leaders(t)


@query("A13", _LEADERS + f"""SELECT l.* FROM l WHERE week < 1600 AND NOT EXISTS (
  SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND {_WEEK} = week AND o_orderpriority = target)""")
def bonus_due(t):
    paid = t.orders.filter("o_orderstatus = 'P'").select(
        F.floor(F.unix_seconds("o_orderdate") / 604_800).alias("week"), F.col("o_orderpriority").alias("target"))
    return L.bonus_due(leaders(t), "week", 1600, paid, ["week", "target"])


_TIER = "CAST(o_orderpriority[1] AS INTEGER)"
_BASE = f"CASE WHEN o_orderstatus = 'P' THEN 5 ELSE CASE {_TIER} WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 25 ELSE 1 END END"


def order_reward():
    return L.base_reward(F.substring("o_orderpriority", 1, 1).cast("int"), F.col("o_orderstatus") == "P")


@query("A14", f"SELECT o_custkey, count(*) AS hits, CAST(sum({_BASE}) AS BIGINT) AS earned FROM orders GROUP BY 1")
def earnings(t):
    return L.earnings(t.orders, "o_custkey", order_reward())


@query("A15", f"""
WITH RECURSIVE h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS prior,
    CAST({_BASE} AS DECIMAL(20,6)) AS base FROM orders),
  f AS (SELECT *, base * CASE WHEN prior >= 1000 THEN 0.5 WHEN prior >= 100 THEN 0.75 ELSE 1 END AS full_reward FROM h),
  g AS MATERIALIZED (SELECT list(full_reward ORDER BY i) AS rewards, count(*) AS n FROM f),
  m AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS minted, CAST(0 AS DOUBLE) AS reward, rewards, n FROM g
    UNION ALL
    SELECT i + 1, minted + least(s * x, greatest(100000 - minted, 0)), least(s * x, greatest(100000 - minted, 0)), rewards, n FROM (
      SELECT i, minted, rewards, n, CAST(rewards[i + 1] AS DOUBLE) AS x,
        CASE WHEN minted > 75000 THEN 0.125 WHEN minted > 50000 THEN 0.25 WHEN minted > 25000 THEN 0.5 ELSE 1 END AS s
      FROM m WHERE i < n))
SELECT o_orderkey, prior AS prior_hits, round(reward, 6) AS reward FROM f JOIN m USING (i)""")
def halved_rewards(t):
    from decimal import Decimal
    steps = [Decimal(25_000), Decimal(50_000), Decimal(75_000)]
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", order_reward().alias("base"))
    out = L.halved_rewards(rows, ["o_orderdate", "o_orderkey"], "o_orderpriority", F.col("base"), steps, Decimal(100_000))
    return out.select("o_orderkey", "prior_hits", F.col("reward").cast("double").alias("reward"))


@query("W6", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS prior_hits FROM orders""")
def prior_hits(t):
    from ..operators.windows import prior_hits as prior
    return prior(t.orders, "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "prior_hits")


@query("A21", """
SELECT l_suppkey, total_validations, confirmations, CAST(confirmations * 10000 // total_validations AS INTEGER) AS reputation_bps FROM (
  SELECT l_suppkey, count(*) AS total_validations, count(CASE WHEN abs(l_extendedprice * 4 - o_totalprice) <= 0.4 * o_totalprice THEN 1 END) AS confirmations
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""")
def validator_stats(t):
    from ..operators.aggregates import validator_stats as stats
    both = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    agrees = F.abs(F.col("l_extendedprice") * 4 - F.col("o_totalprice")) <= 0.4 * F.col("o_totalprice")
    return stats(both, "l_suppkey", agrees)


@query("A22", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, count(*) AS screened,
  count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS hits, min(round(o_totalprice * -30.0, 3)) AS best_affinity FROM orders GROUP BY 1, 2""")
def daily_report(t):
    from ..operators.aggregates import daily_report as report
    rows = t.orders.withColumn("affinity", to_affinity("o_totalprice"))
    return report(rows, F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", "affinity", F.col("o_totalprice") > 250_000)


@query("A22", f"""
SELECT o_custkey, count(*) AS hits, CAST(sum({_BASE}) AS BIGINT) AS earned FROM orders GROUP BY 1 ORDER BY earned DESC, o_custkey LIMIT 10""")
def leaderboard(t):
    from ..operators.aggregates import leaderboard as board
    return board(t.orders.withColumn("reward", order_reward()), "o_custkey", "reward", 10)
