"""Queries that compare arms: seeding, suppression and pruning, one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import arms as A
from loomgraph.operators import candidates as C
from loomgraph.operators import shapes as H
from loomgraph.operators import window as W
from loomgraph.operators.stage import once, stage
from loomgraph.plans.core import EXPAND, INNER, PRUNE, RINGS, TEND, TO_CAND, TO_SEEDS, _active, _by_size, _member, _pairs, ctes, greedy
from loomgraph.plans.further import DRAW
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R

LOOKBACK = f"SELECT 'lookback', now, node FROM (SELECT now, src AS node FROM cycles JOIN edges ON {TEND} <= now AND {TEND} > now - 180 UNION SELECT now, dst FROM cycles JOIN edges ON {TEND} <= now AND {TEND} > now - 180) WHERE (now, node) IN (SELECT (now, node) FROM through)"
SEEDED = f"arm_s AS (SELECT 'passthrough' AS arm, now, seed FROM seeds UNION ALL {LOOKBACK} UNION ALL SELECT DISTINCT 'cheat', now, node FROM (SELECT now, node FROM act UNION SELECT now, seed FROM seeds)), alls AS (SELECT DISTINCT now, seed FROM arm_s)"
SETS = "sets AS (SELECT now, seed, list_sort(list(node)) AS nodes FROM pr GROUP BY ALL HAVING count(*) >= 3), ac AS (SELECT arm, now, array_to_string(nodes, ',') AS key, min(seed) AS seed, any_value(nodes) AS nodes, CAST(max(len(nodes)) AS INT) AS size FROM sets JOIN arm_s USING (now, seed) GROUP BY arm, now, 3)"
ROWS = """ks AS (SELECT DISTINCT now, key, nodes, size FROM ac), kn AS (SELECT now, key, size, unnest(nodes) AS node FROM ks),
 kh AS (SELECT kn.now, kn.key, a.ring FROM kn JOIN act a ON a.now = kn.now AND a.node = kn.node GROUP BY kn.now, kn.key, kn.size, a.ring, a.ring_size HAVING count(*) * 1.0 / a.ring_size >= 0.5 AND count(*) * 1.0 / (kn.size + a.ring_size - count(*)) >= 0.3),
 rk AS (SELECT arm, now, key, row_number() OVER (PARTITION BY arm, now ORDER BY size DESC, key) AS rank, CASE WHEN EXISTS (SELECT 1 FROM kh WHERE kh.now = ac.now AND kh.key = ac.key) THEN 1 ELSE 0 END AS hit FROM ac),
 cell AS (SELECT arm, now, k FROM (SELECT DISTINCT arm FROM ac), (SELECT DISTINCT now FROM act), (SELECT unnest([5, 10]) AS k)),
 ar AS (SELECT c.arm, c.now, c.k, coalesce(CAST(sum(hit) AS BIGINT), 0) AS hit, count(rank) AS n FROM cell c LEFT JOIN rk ON rk.arm = c.arm AND rk.now = c.now AND rank <= c.k GROUP BY ALL)"""
TO_ARMS = (*TO_SEEDS, RINGS, SEEDED, EXPAND.replace("FROM seeds", "FROM alls"), INNER.format(m="mem").replace("inr AS", "inr0 AS", 1), PRUNE, SETS)


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds of the arms, their candidates, the rings. One expansion serves all arms."""

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        e, p, rings = R.edges(spark, d), stage(_pairs(spark, d)), stage(_active(spark, d))
        base = stage(C.seeds(e, p))
        inside = rings.select("now", F.col("node").alias("seed"))
        seeds = A.seed_arms({"passthrough": base, "lookback": C.seeds(e, p, lookback=3), "cheat": base.union(inside)})
        member = stage(C.expand(seeds.select("now", "seed").distinct(), stage(W.neighbours(p)), max_nodes=None))
        return seeds, stage(A.arm_candidates(seeds, stage(C.prune_leaves(member, C.induced(member, p))))), rings

    return once(spark, f"{d}/events.parquet", "arms", make)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    _, cand, rings = _arms(spark, d)
    return once(spark, f"{d}/events.parquet", "arm-rows", lambda: stage(A.arm_rows(cand, rings)))


@query("ev_seed_arms", ctes(*TO_ARMS, ROWS) + "SELECT arm, k, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS n, round(sum(hit) * 1.0 / sum(n), 6) AS p FROM ar GROUP BY arm, k")
def _(spark, d):
    return A.precision(_rows(spark, d)).withColumn("p", F.round("p", 6))


@query("ev_lookback", ctes(*TO_ARMS) + "SELECT arm, count(*) AS n_candidates, count(DISTINCT now) AS n_cycles FROM ac GROUP BY arm")
def _(spark, d):
    return _arms(spark, d)[1].groupBy("arm").agg(F.count("*").alias("n_candidates"), F.count_distinct("now").alias("n_cycles"))


MERGED = "mg AS (SELECT a.now, a.k, a.hit AS hit_a, a.n AS n_a, b.hit AS hit_b, b.n AS n_b FROM ar a JOIN ar b ON a.now = b.now AND a.k = b.k AND a.arm = 'passthrough' AND b.arm = 'cheat')"


@query("jn_merge_arms", ctes(*TO_ARMS, ROWS, MERGED) + "SELECT * FROM mg")
def _(spark, d):
    return A.merged(_rows(spark, d), "passthrough", "cheat")


@query("ev_seeding_ratio", ctes(*TO_ARMS, ROWS, MERGED) + f""", cyc AS (SELECT now, row_number() OVER (ORDER BY now) - 1 AS i FROM (SELECT DISTINCT now FROM mg)), nc AS (SELECT count(*) AS n FROM cyc),
 dr AS (SELECT r, now FROM (SELECT r, {DRAW} % n AS i FROM range(0, 2000) x(r), nc, range(0, 100000) y(j) WHERE j < n) JOIN cyc USING (i)),
 sm AS (SELECT r, k, sum(hit_a) AS ha, sum(n_a) AS na, sum(hit_b) AS hb, sum(n_b) AS nb FROM (SELECT * FROM dr UNION ALL SELECT -1, now FROM cyc) JOIN mg USING (now) GROUP BY r, k),
 v AS (SELECT r, k, CASE WHEN ha > 0 AND nb > 0 THEN (hb * 1.0 / nb) / (ha * 1.0 / na) END AS v FROM sm), l AS (SELECT k, max(v) FILTER (r < 0) AS ratio, list_sort(list(v) FILTER (r >= 0 AND v IS NOT NULL)) AS vs FROM v GROUP BY k)
 SELECT k, round(ratio, 6) AS ratio, round(vs[CAST(floor(len(vs) * 0.025 + 1e-9) AS BIGINT) + 1], 6) AS low, round(vs[least(CAST(floor(len(vs) * 0.975 + 1e-9) AS BIGINT), len(vs) - 1) + 1], 6) AS high FROM l""")
def _(spark, d):
    r = A.seeding_ratio(A.merged(_rows(spark, d), "passthrough", "cheat"))
    return r.select("k", *[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])


@query("so_cheat_cells", ctes(*TO_ARMS, ROWS) + """, fl AS (SELECT r.ring, max(CAST(s.arm = 'passthrough' AS INT)) AS sh, max(CAST(s.arm = 'cheat' AS INT)) AS sc FROM (SELECT DISTINCT ring FROM act) r LEFT JOIN act a ON a.ring = r.ring LEFT JOIN arm_s s ON s.now = a.now AND s.seed = a.node GROUP BY r.ring),
 bt AS (SELECT kh.ring, max(CAST(ac.arm = 'passthrough' AS INT)) AS bh, max(CAST(ac.arm = 'cheat' AS INT)) AS bc FROM kh JOIN ac ON ac.now = kh.now AND ac.key = kh.key GROUP BY kh.ring)
 SELECT coalesce(sh, 0) AS seeded_honest, coalesce(sc, 0) AS seeded_cheat, coalesce(bh, 0) AS built_honest, coalesce(bc, 0) AS built_cheat, count(*) AS n_rings FROM fl LEFT JOIN bt USING (ring) GROUP BY ALL""")
def _(spark, d):
    seeds, cand, rings = _arms(spark, d)
    return A.cheat_cells(seeds, cand, rings, "passthrough", "cheat")


PLACES = {"score": "size DESC, key", "largest": "size DESC, key", "smallest": "size, key", "key": "key"}


def _all_orders() -> str:
    """Greedy suppression in every order; names of CTEs get the order's."""
    parts, ends = [], []
    for k, order in PLACES.items():
        body, end = greedy(order).split("\nSELECT o.now")
        for name in ("od", "mk", "lk", "bl", "nn", "walk", "fin", "took"):
            body, end = (re_word(name, f"{name}_{k}", x) for x in (body, end))
        parts.append(body)
        ends.append(f"SELECT '{k}' AS arm, count(*) AS n_kept, CAST(sum(absorbed) AS BIGINT) AS n_absorbed FROM (SELECT o.now{end})")
    return "WITH RECURSIVE " + ",\n".join([*TO_CAND, *parts]) + "\n" + " UNION ALL ".join(ends)


def re_word(old: str, new: str, text: str) -> str:
    import re

    return re.sub(rf"\b{old}\b", new, text)


@query("ev_suppress_arms", _all_orders())
def _(spark, d):
    return A.suppress_totals(_by_size(spark, d))


PRUNED = "arm_m AS (SELECT 'none' AS arm, now, seed, node FROM mem UNION ALL SELECT 'leaf2', now, seed, node FROM pr), sets AS (SELECT arm, now, seed, list_sort(list(node)) AS nodes FROM arm_m GROUP BY ALL HAVING count(*) >= 3), ac AS (SELECT arm, now, array_to_string(nodes, ',') AS key, min(seed) AS seed, any_value(nodes) AS nodes, CAST(max(len(nodes)) AS INT) AS size FROM sets GROUP BY arm, now, 3)"


@query("ev_prune_ab", ctes(*TO_SEEDS, RINGS, EXPAND, INNER.format(m="mem").replace("inr AS", "inr0 AS", 1), PRUNE, PRUNED, ROWS) + "SELECT arm, k, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS n, round(sum(hit) * 1.0 / sum(n), 6) AS p FROM ar GROUP BY arm, k")
def _(spark, d):
    m, p = _member(spark, d)
    m = stage(m.select("now", "seed", "node"))
    arms = {"none": m, "leaf2": C.prune_leaves(m, C.induced(m, p))}
    both = None
    for name, x in arms.items():
        own = x.select(F.lit(name).alias("arm"), "now", "seed", "node")
        both = own if both is None else both.union(own)
    return A.precision(A.arm_rows(stage(A.arm_candidates(m, both)), stage(_active(spark, d)))).withColumn("p", F.round("p", 6))


@query("ev_prune_arms")
def _(spark, d):
    m, p = _member(spark, d)
    inner = stage(C.induced(m, p))
    both = m.select(F.lit("none").alias("arm"), "now", "seed", "node").union(C.prune_leaves(m, inner).select(F.lit("leaf2"), "now", "seed", "node"))
    for rule in ("kcore2", "near_or_linked"):
        both = both.union(H.pruned(m, inner, rule).select(F.lit(rule), "now", "seed", "node"))
    return A.precision(A.arm_rows(stage(A.arm_candidates(m, both)), stage(_active(spark, d))))
