"""Queries of calibration, append-only logs, ledgers, training rows, costs per group, and orders of a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import cases as K
from loomgraph.operators import economics
from loomgraph.operators.stage import stage
from loomgraph.plans.casework import VERDICTS, _cases
from loomgraph.plans.core import ctes
from loomgraph.plans.further import DRAW, _folder
from loomgraph.plans.features import TO_SCORE
from loomgraph.plans.graph import recursive
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R
from loomgraph.sources import sinks

GROUP = "((case_id * 7919 + 7) % 2147483647)"
for _step in range(3):
    GROUP = f"(({GROUP} * 48271 + 11) % 2147483647)"
LIFTS = f"""gs AS (SELECT {GROUP} % 200 AS g, term, sum(CASE WHEN v > 0 THEN w ELSE 0.0 END) AS fn, sum(CASE WHEN v > 0 THEN w * y ELSE 0.0 END) AS fp, sum(CASE WHEN v > 0 THEN 0.0 ELSE w END) AS nn, sum(CASE WHEN v > 0 THEN 0.0 ELSE w * y END) AS np FROM (SELECT *, CASE WHEN lane = 'control' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CASE WHEN verdict = 'confirmed_ring' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM ct) GROUP BY ALL),
 gi AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM (SELECT DISTINCT g FROM gs)), gn AS (SELECT count(*) AS n FROM gi),
 gd AS (SELECT r, g FROM (SELECT r, {DRAW} % n AS i FROM range(0, 500) x(r), gn, range(0, 1000) z(j) WHERE j < n) JOIN gi USING (i) UNION ALL SELECT -1, g FROM gi),
 gl AS (SELECT r, term, CASE WHEN sum(np) > 0 THEN CASE WHEN sum(fn) > 0 THEN sum(fp) / sum(fn) ELSE 0 END / (sum(np) / sum(nn)) WHEN sum(fp) > 0 THEN 10 ELSE 1 END AS v FROM gd JOIN gs USING (g) GROUP BY r, term),
 li AS (SELECT term, max(v) FILTER (r < 0) AS lift, list_sort(list(v) FILTER (r >= 0))[13] AS low, list_sort(list(v) FILTER (r >= 0))[488] AS high FROM gl GROUP BY term)"""
GATED = """wt AS (SELECT unnest(['conservation', 'cycle', 'burstiness', 'stack']) AS term, unnest([0.5, 0.3, 0.1, 0.1])::DOUBLE AS weight),
 nw AS (SELECT term, weight, lift, low, high, CASE WHEN raw_fired IS NULL THEN 'not_a_scored_term' WHEN raw_fired < 20 OR raw_not_fired < 20 THEN 'too_few_observations' WHEN low <= 1 AND high >= 1 THEN 'ci_includes_one' ELSE 'moved' END AS status FROM wt LEFT JOIN te USING (term) LEFT JOIN li USING (term)),
 mv AS (SELECT *, CASE WHEN status = 'moved' THEN weight + 0.25 * (least(1, weight * least(lift, 5)) - weight) ELSE weight END AS raw FROM nw),
 cal AS (SELECT term, weight, status, CASE WHEN status IN ('moved', 'ci_includes_one') THEN round(low, 6) END AS low, CASE WHEN status IN ('moved', 'ci_includes_one') THEN round(high, 6) END AS high, round(raw / sum(raw) OVER (), 6) AS new_weight FROM mv)"""


def _calibration(spark: SparkSession, d: str) -> DataFrame:
    cases = stage(_cases(spark, d))
    w = spark.createDataFrame([("conservation", 0.5), ("cycle", 0.3), ("burstiness", 0.1), ("stack", 0.1)], "term string, weight double")
    c = K.calibrated(K.term_evidence(cases), K.lift_intervals(cases), w)
    return c.select("term", "weight", "status", *[F.round(x, 6).alias(x) for x in ("low", "high", "new_weight")])


@query("ml_calibrate", ctes(VERDICTS, LIFTS, GATED) + "SELECT * FROM cal")
def _(spark, d):
    return _calibration(spark, d)


@query("hp_lift_interval", ctes(VERDICTS, LIFTS) + "SELECT term, round(lift, 6) AS lift, round(low, 6) AS low, round(high, 6) AS high FROM li")
def _(spark, d):
    return K.lift_intervals(stage(_cases(spark, d))).select("term", *[F.round(c, 6).alias(c) for c in ("lift", "low", "high")])


@query("snk_calibration_log", ctes(VERDICTS, LIFTS, GATED) + "SELECT p.pass, term, status, new_weight FROM cal, (SELECT unnest([1, 2])::BIGINT AS pass) p")
def _(spark, d):
    path = f"{_folder(spark, 'calibrations')}/log"
    c = stage(_calibration(spark, d).select("term", "status", "new_weight"))
    for k in (1, 2, 2):  # the second pass is written twice, as a job tried again would
        sinks.append_events(c.withColumn("pass", F.lit(k)), path)
    return R.events(spark, path).select("pass", "term", "status", "new_weight")


@query("snk_reco_append", """SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 4 = 3 THEN 'PENDING' WHEN o_orderkey % 4 = 2 THEN 'REJECTED' ELSE 'APPROVED' END AS status, o_orderkey % 4 = 0 AS executed FROM orders WHERE o_orderkey % 9 <> 0""")
def _(spark, d):
    path = f"{_folder(spark, 'recommendations')}/log"
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("rec_id"))
    event = lambda rows, at, name, **more: rows.select("rec_id", F.lit(at).alias("at"), F.lit(name).alias("event"), *[more.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("evidence", "array<string>"), ("rationale", "string"), ("by", "string"), ("approved", "boolean"))])
    asked = event(o, 1, "recommend", evidence=F.array(F.lit("TXN-1")), rationale=F.when(F.col("rec_id") % 9 == 0, " ").otherwise("why"))
    decided = event(o.filter("rec_id % 4 <> 3"), 2, "decide", by=F.lit("analyst"), approved=F.col("rec_id") % 4 != 2)
    done = event(o.filter("rec_id % 4 = 0 or rec_id % 4 = 2"), 3, "execute")
    for rows in (asked, decided, done, done):
        sinks.append_events(rows, path)
    return K.recommendations(R.events(spark, path))


OUTCOME = "CASE doc_id % 7 WHEN 0 THEN 'llm_unavailable' WHEN 1 THEN 'llm_rejected_uncited' WHEN 2 THEN 'llm_rejected_unverifiable' ELSE 'llm_filed' END"


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafting outcomes of documents, written to a log and read back."""
    k = F.col("doc_id") % 7
    path = f"{_folder(spark, 'drafts')}/log"
    outcome = F.when(k == 0, "llm_unavailable").when(k == 1, "llm_rejected_uncited").when(k == 2, "llm_rejected_unverifiable").otherwise("llm_filed")
    sinks.append_events(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", outcome.alias("outcome")), path)
    return R.events(spark, path)


@query("snk_draft_ledger", f"SELECT doc_id, {OUTCOME} AS outcome FROM documents")
def _(spark, d):
    return _drafts(spark, d).select("doc_id", "outcome")


@query("ag_draft_ledger", f"SELECT *, llm_filed + rejected AS attempted, rejected * 1.0::DOUBLE / (llm_filed + rejected) AS rejection_rate FROM (SELECT *, llm_rejected_uncited + llm_rejected_unverifiable AS rejected FROM (SELECT count(*) FILTER (o = 'llm_filed') AS llm_filed, count(*) FILTER (o = 'llm_rejected_uncited') AS llm_rejected_uncited, count(*) FILTER (o = 'llm_rejected_unverifiable') AS llm_rejected_unverifiable, count(*) FILTER (o = 'llm_unavailable') AS llm_unavailable FROM (SELECT {OUTCOME} AS o FROM documents)))")
def _(spark, d):
    return K.draft_ledger(_drafts(spark, d))


def _console(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    verdict = F.when(F.col("o_orderstatus") == "F", "confirmed_ring").when(F.col("o_orderkey") % 3 == 0, "pending").otherwise("not_a_ring")
    features = F.create_map(F.lit("price"), F.col("o_totalprice").cast("double"), F.lit("customer"), F.col("o_custkey").cast("double"))
    return o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 10 == 0, "control").otherwise("primary").alias("lane"), verdict.alias("verdict"), (F.col("o_custkey") % 30 + 3).alias("size"), (F.col("o_orderkey") % 600).cast("double").alias("seconds"), features.alias("features"))


CONSOLE = "co AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 10 = 0 THEN 'control' ELSE 'primary' END AS lane, CASE WHEN o_orderstatus = 'F' THEN 'confirmed_ring' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'not_a_ring' END AS verdict, o_custkey % 30 + 3 AS size, (o_orderkey % 600)::DOUBLE AS seconds, o_totalprice, o_custkey FROM orders)"


@query("ag_console_stats", ctes(CONSOLE) + "SELECT count(*) AS n, count(*) FILTER (verdict = 'pending') AS pending, count(*) FILTER (verdict <> 'pending') AS labelled, round(sum(CASE WHEN verdict = 'confirmed_ring' THEN size ELSE 0 END) * 1.0 / count(*) FILTER (verdict <> 'pending'), 2) AS accounts_per_decision, list_sort(list(seconds) FILTER (verdict <> 'pending' AND seconds > 0))[count(*) FILTER (verdict <> 'pending' AND seconds > 0) // 2 + 1] AS median_seconds FROM co")
def _(spark, d):
    return K.console_stats(_console(spark, d))


@query("ag_training_rows", ctes(CONSOLE) + "SELECT case_id, lane, verdict, CASE WHEN verdict = 'confirmed_ring' THEN 1 ELSE 0 END AS label, round(o_totalprice::DOUBLE, 2) AS f_price, o_custkey::DOUBLE AS f_customer FROM co WHERE verdict <> 'pending'")
def _(spark, d):
    t = K.training_rows(_console(spark, d))
    return t.select("case_id", "lane", "verdict", "label", F.round(F.col("features")["f_price"], 2).alias("f_price"), F.col("features")["f_customer"].alias("f_customer"))


@query("fn_access", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE o_orderkey % 3 WHEN 0 THEN 1825 WHEN 1 THEN 730 ELSE 1095 END <= DATE '1998-01-01' AS expired, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority[1] IN ('1', '2') WHEN 1 THEN o_orderpriority[1] IN ('1', '3') ELSE o_orderpriority[1] = '4' END AS allowed FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    purpose = F.element_at(F.array(*[F.lit(k) for k in S.RETENTION]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    role = F.substring("o_orderpriority", 1, 1)
    role = F.when(role == "1", "compliance").when(role == "2", "fiu_ind_liaison").when(role == "3", "fraud_ops").when(role == "4", "ml_engineering").otherwise("nobody")
    return o.select("o_orderkey", S.is_expired(F.col("o_orderdate").cast("date"), purpose, F.lit("1998-01-01").cast("date")).alias("expired"), S.can_access(purpose, role).alias("allowed"))


@query("fn_validate_reason", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 3 = 0 WHEN 1 THEN o_custkey % 3 = 1 WHEN 2 THEN o_custkey % 3 = 2 ELSE false END AS fits FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    verdict = F.element_at(F.array(*[F.lit(k) for k in ("confirmed_ring", "benign_explained", "insufficient_evidence", "pending", "confirmed_partial")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    reason = F.element_at(F.array(*[F.lit(k) for k in ("layering", "payroll_hub", "needs_kyc")]), (F.col("o_custkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", S.reason_fits(verdict, reason).alias("fits"))


SEGMENTS = "sg AS (SELECT c_mktsegment AS \"group\", avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(o_totalprice)::DOUBLE AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)"
MODEL = """cm AS (SELECT "group", p, input, factor, 45.0 * CASE WHEN input = 'minutes_per_case' THEN factor ELSE 1 END / 60 * 1500.0 * CASE WHEN input = 'cost_per_hour' THEN factor ELSE 1 END AS review, value * CASE WHEN input = 'value_at_risk' THEN factor ELSE 1 END AS v, least(1, 0.35 * CASE WHEN input = 'recovery_rate' THEN factor ELSE 1 END) AS r, 20000.0 * CASE WHEN input = 'harm_per_false_positive' THEN factor ELSE 1 END AS harm
 FROM sg, (SELECT unnest(['minutes_per_case', 'cost_per_hour', 'value_at_risk', 'recovery_rate', 'harm_per_false_positive']) AS input), (SELECT unnest([0.1, 0.5, 1, 2, 10])::DOUBLE AS factor))"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy(F.col("c_mktsegment").alias("group")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("p"), F.avg("o_totalprice").cast("double").alias("value"))


@query("ec_cost_model", ctes(SEGMENTS, MODEL) + 'SELECT "group", round((review + harm) / (v * r + harm), 6) AS break_even, round(p * v * r - (1 - p) * harm - review, 2) AS net, round((review + (1 - p) * harm) / (p * r), 2) AS required_value FROM cm WHERE input = \'minutes_per_case\' AND factor = 1')
def _(spark, d):
    g = economics.by_group(_segments(spark, d)).filter("input = 'minutes_per_case'")
    return g.select("group", F.round("break_even", 6).alias("break_even"), F.round("net", 2).alias("net"), F.round("required_value", 2).alias("required_value"))


@query("ec_sensitivity", ctes(SEGMENTS, MODEL) + 'SELECT "group", input, factor, round((review + harm) / (v * r + harm), 6) AS break_even, round(p * v * r - (1 - p) * harm - review, 2) AS net FROM cm')
def _(spark, d):
    g = economics.by_group(_segments(spark, d), factors=(0.1, 0.5, 1.0, 2.0, 10.0))
    return g.select("group", "input", "factor", F.round("break_even", 6).alias("break_even"), F.round("net", 2).alias("net"))


@query("ec_optimal_k", """WITH rk AS (SELECT c_nationkey AS "group", CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders JOIN customer ON c_custkey = o_custkey),
 s AS (SELECT "group", k, sum(hit) AS h, count(*) AS n FROM rk, (SELECT unnest([10, 20, 50, 100]) AS k) WHERE rank <= k GROUP BY ALL), t AS (SELECT "group", k, h * 50000 * 0.35 - (n - h) * 20000.0 - n * 1125.0 AS net FROM s QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY h * 50000 * 0.35 - (n - h) * 20000.0 - n * 1125.0 DESC, k) = 1)
 SELECT "group", CASE WHEN net > 0 THEN k END AS k, round(net, 2) AS net FROM t""")
def _(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    order = Window.partitionBy("c_nationkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ranked = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("group"), (F.col("o_orderstatus") == "F").cast("int").alias("hit"), F.row_number().over(order).alias("rank"))
    return economics.best_k_by_group(ranked, (10, 20, 50, 100), 50_000.0).withColumn("net", F.round("net", 2))


ORDERS = {"score": "score DESC, key", "size": "size DESC, key", "degree": "max_fan DESC, key", "random": "h, key"}


@query("wn_rank_orders", recursive(*TO_SCORE, "ro AS (SELECT s.now, s.key, round(s.score, 4) AS score, s.size, s.max_fan, (CAST(('0x' || left(md5(s.key), 7)) AS BIGINT)) AS h FROM scored s)") + "SELECT now, key, " + ", ".join(f"CAST(row_number() OVER (PARTITION BY now ORDER BY {o}) AS INT) AS by_{k}" for k, o in ORDERS.items()) + " FROM ro")
def _(spark, d):
    from loomgraph.plans.features import scored

    s = scored(spark, d).select("now", "key", F.round("score", 4).alias("score"), "size", F.greatest("max_out", "max_in").alias("max_fan"), F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("long").alias("h"))
    by = {"score": F.col("score").desc(), "size": F.col("size").desc(), "degree": F.col("max_fan").desc(), "random": F.col("h")}
    return s.select("now", "key", *[F.row_number().over(Window.partitionBy("now").orderBy(o, "key")).alias(f"by_{k}") for k, o in by.items()])
