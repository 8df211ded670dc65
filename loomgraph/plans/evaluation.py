"""Queries of the funnel, label joins, splits and transaction-level metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import candidates as C
from loomgraph.operators import evaluate as E
from loomgraph.operators import window as W
from loomgraph.operators.stage import stage
from loomgraph.plans.core import CYCLES, EDGES, EXPAND, HITS, ISLANDS, LIVE, RINGS, TO_CAND, TO_SEEDS, _active, _inner, _member, ctes
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R

OVER = "ov AS (SELECT c.now, c.key, c.size, a.ring, a.ring_size, count(*) AS shared FROM cand c JOIN mem2 m USING (now, seed) JOIN act a ON a.now = c.now AND a.node = m.node GROUP BY c.now, c.key, c.size, a.ring, a.ring_size)"
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY now ORDER BY size DESC, key) AS rank FROM cand)"
KINDS = "kinds AS (SELECT DISTINCT ring, CASE ring % 4 WHEN 0 THEN 'CYCLE' WHEN 1 THEN 'FAN-IN' WHEN 2 THEN 'STACK' ELSE 'RANDOM' END AS typology FROM act)"
FUNNEL = """fl AS (SELECT ring, typology, CAST(max(CASE WHEN s.seed IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS seeded, CAST(max(CASE WHEN b.ring IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS built, CAST(max(coalesce(b.top, 0)) AS BIGINT) AS ranked FROM act LEFT JOIN seeds s ON s.now = act.now AND s.seed = act.node JOIN kinds USING (ring)
 LEFT JOIN (SELECT ring, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS top FROM hit JOIN rk USING (now, key) GROUP BY ring) b USING (ring) GROUP BY ring, typology),
 fn AS (SELECT coalesce(typology, 'TOTAL') AS typology, count(*) AS total, CAST(sum(seeded) AS BIGINT) AS seeded, CAST(sum(built) AS BIGINT) AS built, CAST(sum(ranked) AS BIGINT) AS ranked FROM fl GROUP BY ROLLUP (typology))"""


def _ranked(cand):
    return C.ranked(cand, "size")


def _overlap(spark, d):
    return E.overlap(_inner(spark, d)[0], _active(spark, d))


def _funnel(spark, d):
    cand, _, _, p = _inner(spark, d)
    active = stage(_active(spark, d))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("CYCLE", "FAN-IN", "STACK", "RANDOM")]), (F.pmod("ring", F.lit(4)) + 1).cast("int"))
    kinds = active.select("ring").distinct().withColumn("typology", kind)
    return E.funnel(active, kinds, C.seeds(R.edges(spark, d), p), _ranked(cand), E.hits(cand, active), 5)


@query("ev_funnel", ctes(*TO_CAND, RINGS, HITS, RANKED, KINDS, FUNNEL) + "SELECT * FROM fn")
def _(spark, d):
    return _funnel(spark, d)


@query("ev_funnel_annot", ctes(*TO_CAND, RINGS, HITS, RANKED, KINDS, FUNNEL) + "SELECT typology, round(100.0 * (total - seeded) / total, 4) AS seeding_loss, round(100.0 * (seeded - built) / total, 4) AS build_loss, round(100.0 * (built - ranked) / total, 4) AS ranking_loss, round(built * 1.0 / nullif(seeded, 0), 6) AS retention FROM fn")
def _(spark, d):
    return E.losses(_funnel(spark, d))


@query("ev_hits_loose", ctes(*TO_CAND, RINGS, OVER) + "SELECT now, key, ring, shared FROM ov WHERE shared * 1.0 / ring_size >= 0.5")
def _(spark, d):
    return E.hits(_inner(spark, d)[0], _active(spark, d), jaccard=0.0)


@query("ev_pk_distinct_ring", ctes(*TO_CAND, RINGS, HITS, RANKED) + "SELECT k, count(DISTINCT ring) AS rings FROM (SELECT unnest([1, 5, 10]) AS k) JOIN rk ON rank <= k JOIN hit USING (now, key) GROUP BY k")
def _(spark, d):
    cand = _inner(spark, d)[0]
    h = E.hits(cand, _active(spark, d)).join(_ranked(cand).select("now", "key", "rank"), ["now", "key"])
    ks = F.filter(F.array(F.lit(1), F.lit(5), F.lit(10)), lambda k: F.col("rank") <= k)
    return h.select("ring", F.explode(ks).alias("k")).groupBy("k").agg(F.count_distinct("ring").alias("rings"))


@query("hp_label_candidate", ctes(*TO_CAND, RINGS, OVER) + "SELECT now, key, min(ring) AS ring, round(arg_min(shared * 1.0 / size, ring), 6) AS inside FROM ov WHERE shared * 1.0 / ring_size >= 0.5 AND shared * 1.0 / (size + ring_size - shared) >= 0.3 GROUP BY now, key")
def _(spark, d):
    return E.labelled(_overlap(spark, d)).withColumn("inside", F.round("inside", 6))


@query("hp_truth_overlap", ctes(*TO_CAND, RINGS, OVER) + "SELECT now, key, ring, shared FROM ov QUALIFY row_number() OVER (PARTITION BY now, key ORDER BY shared DESC, ring) = 1")
def _(spark, d):
    return E.best_overlap(_overlap(spark, d))


@query("ev_txn_level", ctes(*TO_CAND) + """, pl AS (SELECT now, src, dst, max(label) AS y FROM live GROUP BY now, src, dst), fx AS (SELECT DISTINCT now, src, dst FROM inr),
 t AS (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, count(fx.src) AS flagged, CAST(sum(CASE WHEN fx.src IS NULL THEN 0 ELSE y END) AS BIGINT) AS tp FROM pl LEFT JOIN fx USING (now, src, dst))
 SELECT n, pos, flagged, tp, round(tp * 1.0 / flagged, 6) AS precision, round(tp * 1.0 / pos, 6) AS recall, round(2.0 * tp / (flagged + pos), 6) AS f1, round((tp * 1.0 / flagged) / (pos * 1.0 / n), 6) AS lift FROM t""")
def _(spark, d):
    return E.transaction_level(W.live(R.edges(spark, d)), _inner(spark, d)[0])


ATTEMPT = """at AS (SELECT a.now, a.ring, a.node AS seed, m.node FROM act a JOIN mem m ON m.now = a.now AND m.seed = a.node), o AS (SELECT at.now, at.ring, at.seed, count(*) AS size, count(x.node) AS shared, max(z.ring_size) AS ring_size FROM at LEFT JOIN act x ON x.now = at.now AND x.ring = at.ring AND x.node = at.node JOIN (SELECT DISTINCT now, ring, ring_size FROM act) z ON z.now = at.now AND z.ring = at.ring GROUP BY at.now, at.ring, at.seed),
 b AS (SELECT ring, shared * 1.0 / ring_size AS containment, shared * 1.0 / (size + ring_size - shared) AS jaccard FROM o QUALIFY row_number() OVER (PARTITION BY ring ORDER BY shared * 1.0 / ring_size DESC, shared * 1.0 / (size + ring_size - shared) DESC) = 1)"""


@query("ev_diagnose", ctes(*TO_SEEDS, EXPAND, RINGS, ATTEMPT.replace("at AS", "att AS", 1).replace("at.", "att.").replace("FROM at ", "FROM att ")) + "SELECT ring, round(containment, 6) AS containment, round(jaccard, 6) AS jaccard, CASE WHEN containment < 0.5 THEN 'CONTAINMENT_FAIL' WHEN jaccard < 0.3 THEN 'DILUTION_FAIL' ELSE 'BUILT' END AS verdict FROM b")
def _(spark, d):
    b = E.best_attempt(_member(spark, d)[0], _active(spark, d))
    return b.withColumn("containment", F.round("containment", 6)).withColumn("jaccard", F.round("jaccard", 6))


@query("ev_prune_sweep", ctes(*TO_CAND, RINGS) + """, arms AS (SELECT 'none' AS arm, now, seed, node FROM mem UNION ALL SELECT 'leaf2', now, seed, node FROM pr), sz AS (SELECT arm, now, seed, count(*) AS size FROM arms GROUP BY ALL),
 o AS (SELECT x.arm, a.ring, a.ring_size, size, count(y.node) AS shared FROM act a JOIN sz x ON x.now = a.now AND x.seed = a.node JOIN arms y ON y.arm = x.arm AND y.now = x.now AND y.seed = x.seed JOIN act r ON r.now = a.now AND r.ring = a.ring AND r.node = y.node GROUP BY x.arm, a.now, a.ring, a.ring_size, x.seed, size)
 SELECT arm, ring, round(shared * 1.0 / ring_size, 6) AS containment, round(shared * 1.0 / (size + ring_size - shared), 6) AS jaccard FROM o QUALIFY row_number() OVER (PARTITION BY arm, ring ORDER BY shared * 1.0 / ring_size DESC, shared * 1.0 / (size + ring_size - shared) DESC) = 1""")
def _(spark, d):
    m, p = _member(spark, d)
    active = stage(_active(spark, d))
    arm = lambda x, name: E.best_attempt(x, active).select(F.lit(name).alias("arm"), "ring", F.round("containment", 6).alias("containment"), F.round("jaccard", 6).alias("jaccard"))
    return arm(m, "none").union(arm(stage(C.prune_leaves(m, C.induced(m, p))), "leaf2"))


@query("ev_leak_boundary", ctes(EDGES) + ", days AS (SELECT CAST(floor(t / 1440.0) AS BIGINT) AS day, count(*) AS n, sum(label) AS l FROM edges GROUP BY 1)\nSELECT coalesce(min(day) FILTER (sh <= 0.2 AND li >= 1.02), max(day) + 1) AS boundary FROM (SELECT day, sum(n) OVER w * 1.0 / sum(n) OVER () AS sh, (sum(l) OVER w * 1.0 / sum(n) OVER w) / (sum(l) OVER () * 1.0 / sum(n) OVER ()) AS li FROM days WINDOW w AS (ORDER BY day DESC ROWS UNBOUNDED PRECEDING))")
def _(spark, d):
    days = R.edges(spark, d).groupBy(F.floor(F.col("t") / 1440).alias("day")).agg(F.count("*").alias("n"), F.sum("label").alias("l"))
    return E.leak_boundary(days, 0.2, 1.02)


@query("wn_stratified_auc", """SELECT round(sum(auc * w) / sum(w), 5) AS auc, CAST(sum(w) AS BIGINT) AS n_pairs FROM (SELECT event_type, sum(y) * sum(1 - y) AS w, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc
 FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events) GROUP BY event_type)""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "value", (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return E.stratified_auc(e, "value", "y", "event_type")


SPLIT = """lab AS (SELECT now, key, min(ring) AS ring FROM hit GROUP BY now, key), rws AS (SELECT c.now, c.key, ring FROM cand c LEFT JOIN lab USING (now, key)), fr AS (SELECT ring, min(now) AS start FROM rws WHERE ring IS NOT NULL GROUP BY ring),
 sid AS (SELECT ring, start, row_number() OVER (ORDER BY start, ring) > floor(count(*) OVER () * 0.7) AS tr FROM fr), ct AS (SELECT min(start) AS cut FROM sid WHERE tr)
 SELECT now, key, ring, CASE WHEN ring IS NULL THEN CASE WHEN now >= cut THEN 'test' ELSE 'train' END WHEN tr THEN CASE WHEN now >= cut THEN 'test' ELSE 'dropped' END WHEN now >= cut THEN 'dropped' ELSE 'train' END AS side FROM rws LEFT JOIN sid USING (ring), ct"""


@query("wn_ring_time_split", ctes(*TO_CAND, RINGS, HITS, SPLIT.split("\n SELECT")[0]) + "SELECT" + SPLIT.split("\n SELECT")[1])
def _(spark, d):
    cand = _inner(spark, d)[0]
    lab = E.hits(cand, _active(spark, d)).groupBy("now", "key").agg(F.min("ring").alias("ring"))
    return E.ring_split(stage(cand.select("now", "key").join(lab, ["now", "key"], "left")))


@query("sd_override", ctes(*TO_SEEDS, RINGS) + "SELECT now, seed FROM seeds UNION SELECT now, node FROM act")
def _(spark, d):
    e = R.edges(spark, d)
    p = W.pairs(W.live(W.islands(e)))
    return C.seeds(e, p).union(_active(spark, d).select("now", "node")).distinct()


@query("so_union_recall", ctes(*TO_CAND, RINGS, HITS) + "SELECT ring % 4 AS kind, count(DISTINCT act.ring) AS seen, count(DISTINCT hit.ring) AS found FROM act LEFT JOIN hit USING (now, ring) GROUP BY 1")
def _(spark, d):
    active = stage(_active(spark, d))
    h = E.hits(_inner(spark, d)[0], active).select("now", "ring", F.col("ring").alias("hit")).distinct()
    j = active.select("now", "ring").distinct().join(h, ["now", "ring"], "left")
    return j.groupBy((F.col("ring") % 4).alias("kind")).agg(F.count_distinct("ring").alias("seen"), F.count_distinct("hit").alias("found"))


@query("hp_ring_trials", ctes(*TO_CAND, RINGS, HITS, RANKED) + "SELECT now, ring, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS surfaced FROM hit JOIN rk USING (now, key) GROUP BY now, ring")
def _(spark, d):
    cand = _inner(spark, d)[0]
    h = E.hits(cand, _active(spark, d)).join(_ranked(cand).select("now", "key", "rank"), ["now", "key"])
    return h.groupBy("now", "ring").agg(F.max((F.col("rank") <= 5).cast("int")).alias("surfaced"))


@query("jn_label_profile", ctes(EDGES) + "SELECT channel, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_labelled, CAST(sum(CASE WHEN label = 1 AND src % 20 < 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_joined FROM edges GROUP BY channel")
def _(spark, d):
    e = R.edges(spark, d)
    known = R.rings(spark, d).filter("ring < 10").select("seq", F.lit(1).alias("j"))
    return e.join(known, "seq", "left").groupBy("channel").agg(F.count("*").alias("n"), F.sum("label").alias("n_labelled"), F.count("j").alias("n_joined"))
