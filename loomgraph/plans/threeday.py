"""The window of 72 hours sliding by 6, from expansion to evaluation: cycles overlap, and recurring pairs expire edge by edge."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import candidates as C
from loomgraph.operators import evaluate as E
from loomgraph.operators import links as L
from loomgraph.operators import spells as P
from loomgraph.operators import window as W
from loomgraph.operators.stage import once, stage
from loomgraph.plans.core import TO_SEEDS as SHORT_SEEDS
from loomgraph.plans.core import CAND, CYCLES, DEG, EXPAND, FLOW, HITS, INNER, ISLANDS, LAYERS, LIVE, NBRS, PRUNE, RINGS, SEEDS, THROUGH, TOUCHED, _active, _seeded, ctes, greedy
from loomgraph.plans.evaluation import ATTEMPT, FUNNEL, KINDS, OVER, RANKED
from loomgraph.plans.features import LEVELS
from loomgraph.plans.further import DAYS3, LONG
from loomgraph.plans.graph import LINK
from loomgraph.plans.registry import SPECS, query
from loomgraph.sources import readers as R

TO_SEEDS = (*LONG, NBRS, DEG, TOUCHED, THROUGH, SEEDS)
TO_CAND = (*TO_SEEDS, EXPAND, INNER.format(m="mem").replace("inr AS", "inr0 AS", 1), PRUNE, CAND, INNER.format(m="mem2"))


def tail(name: str) -> str:
    """The oracle of the query ``name`` with the long window in place of the short one."""
    sql = SPECS[name].sql
    for short, long in zip((CYCLES, ISLANDS, LIVE), LONG[1:4], strict=True):
        sql = sql.replace(short, long)
    return sql


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The long window's seeds, spells and degrees; staged once for all queries over the same files."""

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        e = R.edges(spark, d)
        linked = stage(P.spells(e, DAYS3))
        degree = stage(P.degrees(e, linked, DAYS3))
        return stage(P.seeds(e, degree)), linked, degree

    return once(spark, f"{d}/events.parquet", "linked", make)


def _reached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Expansions of the long window's seeds, bounded by degrees and hops only, and the pairs among their nodes; staged once likewise."""

    def make() -> tuple[DataFrame, DataFrame]:
        m = stage(P.reached(*_linked(spark, d), DAYS3))
        return m, stage(P.pairs_among(R.edges(spark, d), m, DAYS3))

    return once(spark, f"{d}/events.parquet", "reached", make)


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``candidates.candidates`` of the long window; its pairs are those among members."""
    return once(spark, f"{d}/events.parquet", "reached-candidates", lambda: C.from_members(*_reached(spark, d)))


def traced_sql(degree: int, nodes: int) -> str:
    """Two traced hops; goes after the seeds."""
    return f"""f0 AS (SELECT s.now, s.seed, coalesce(deg, 0) AS deg FROM seeds s LEFT JOIN deg ON deg.now = s.now AND deg.node = s.seed),
 x1 AS (SELECT f.now, f.seed, n.other AS node, d.deg FROM f0 f JOIN nbrs n ON n.now = f.now AND n.node = f.seed JOIN deg d ON d.now = f.now AND d.node = n.other WHERE f.deg <= {degree}),
 r1 AS (SELECT *, row_number() OVER (PARTITION BY now, seed ORDER BY deg, node) AS rn, count(*) OVER (PARTITION BY now, seed) AS n FROM x1), f1 AS (SELECT * FROM r1 WHERE rn <= {nodes} - 1),
 m1 AS (SELECT now, seed, seed AS node FROM seeds UNION ALL SELECT now, seed, node FROM f1),
 x2 AS (SELECT DISTINCT f.now, f.seed, n.other AS node, d.deg FROM f1 f JOIN nbrs n ON n.now = f.now AND n.node = f.node JOIN deg d ON d.now = f.now AND d.node = n.other WHERE f.deg <= {degree} AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.now = f.now AND m1.seed = f.seed AND m1.node = n.other)),
 z AS (SELECT now, seed, count(*) AS size FROM m1 GROUP BY ALL), r2 AS (SELECT x2.*, row_number() OVER (PARTITION BY now, seed ORDER BY deg, node) AS rn, count(*) OVER (PARTITION BY now, seed) AS n, {nodes} - size AS room FROM x2 JOIN z USING (now, seed)), f2 AS (SELECT * FROM r2 WHERE rn <= room),
 traced AS (SELECT f0.now, f0.seed, CAST(1 + coalesce(k1, 0) + coalesce(k2, 0) AS INT) AS size, CAST(CASE WHEN n1 IS NULL THEN 0 WHEN k2 IS NULL THEN 1 ELSE 2 END AS INT) AS hops_completed, CAST(CAST(f0.deg > {degree} AS INT) + coalesce(b1, 0) AS INT) AS hub_blocked, coalesce(n1 > k1, false) OR coalesce(n2 > k2, false) AS truncated, n1 IS NULL OR n2 IS NULL AS exhausted, coalesce(n2 > 0 AND k2 IS NULL, false) AS hit_node_cap
 FROM f0 LEFT JOIN (SELECT now, seed, max(n) AS n1, count(*) AS k1, count(*) FILTER (deg > {degree}) AS b1 FROM f1 GROUP BY ALL) USING (now, seed) LEFT JOIN (SELECT now, seed, max(n) AS n2 FROM r2 GROUP BY ALL) USING (now, seed) LEFT JOIN (SELECT now, seed, count(*) AS k2 FROM f2 GROUP BY ALL) USING (now, seed))"""


TRACE = "now, seed, size, hops_completed, hub_blocked, truncated, exhausted, hit_node_cap"


def _trace(traced: DataFrame) -> DataFrame:
    return traced.select("now", "seed", F.size("nodes").alias("size"), "hops_completed", "hub_blocked", "truncated", "exhausted", "hit_node_cap")


@query("gr_expand_traced", ctes(*TO_SEEDS, traced_sql(50, 200)) + f"SELECT {TRACE} FROM traced")
def _(spark, d):
    return _trace(P.expand_traced(*_linked(spark, d), DAYS3))


TIGHT = {"max_degree": 12, "max_nodes": 20}  # bounds that bind on small graphs
TO_TIGHT = (*TO_SEEDS, traced_sql(12, 20), "mem AS (SELECT now, seed, node FROM m1 UNION ALL SELECT now, seed, node FROM f2)")
TO_TIGHT_CAND = (*TO_TIGHT, INNER.format(m="mem").replace("inr AS", "inr0 AS", 1), PRUNE, CAND, INNER.format(m="mem2"))
STOPPED = "CASE WHEN hit_node_cap OR truncated THEN 'node_cap' WHEN hub_blocked > 0 THEN 'hub_guard' WHEN exhausted THEN 'out_of_reach' ELSE 'hop_limit' END"


def _tight(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, f"{d}/events.parquet", "tight", lambda: stage(P.expand_traced(*_linked(spark, d), DAYS3, **TIGHT)))


def _tight_candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    m = C.members(_tight(spark, d))
    return once(spark, f"{d}/events.parquet", "tight-candidates", lambda: C.from_members(m, stage(P.pairs_among(R.edges(spark, d), m, DAYS3))))


@query("gr_expand_traced_tight", ctes(*TO_TIGHT) + f"SELECT {TRACE}, {STOPPED} AS stopped_by FROM traced")
def _(spark, d):
    return _trace(_tight(spark, d)).withColumn("stopped_by", C.stopped_by())


@query("gr_expand_72h", ctes(*TO_SEEDS, EXPAND) + "SELECT now, seed, node FROM mem")
def _(spark, d):
    return _reached(spark, d)[0].select("now", "seed", "node")


@query("gr_subgraph_72h", ctes(*TO_SEEDS, EXPAND, INNER.format(m="mem")) + "SELECT now, seed, count(*) AS n_pairs, CAST(sum(cnt) AS BIGINT) AS n_edges, min(first_t) AS first_t, max(last_t) AS last_t FROM inr GROUP BY now, seed")
def _(spark, d):
    return C.induced(*_reached(spark, d)).groupBy("now", "seed").agg(F.count("*").alias("n_pairs"), F.sum("cnt").alias("n_edges"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


@query("pr_leaf2_72h", tail("pr_leaf2"))
def _(spark, d):
    m, p = _reached(spark, d)
    return C.prune_leaves(m, C.induced(m, p))


@query("gn_dedup_72h", tail("gn_dedup"))
def _(spark, d):
    return _three(spark, d)[0].select("now", "key", "seed", "size")


@query("mo_fan_72h", tail("mo_fan"))
def _(spark, d):
    return C.fans(_three(spark, d)[2])


@query("mo_mutual_72h", tail("mo_mutual"))
def _(spark, d):
    return C.mutual(_three(spark, d)[2])


@query("mo_scatter_gather_72h", tail("mo_scatter_gather"))
def _(spark, d):
    return C.scatter_gather(_three(spark, d)[2])


@query("mo_gather_scatter_72h", tail("mo_gather_scatter"))
def _(spark, d):
    return C.fans(_three(spark, d)[2]).filter("gs >= 2").select("now", "seed", "gs")


@query("mo_cycles3_72h", tail("mo_cycles3"))
def _(spark, d):
    return C.triangles(_three(spark, d)[2])


@query("mo_layers_72h", ctes(*TO_CAND, LEVELS, "lay AS (" + LAYERS + ")") + "SELECT now, seed, round(gargaml, 6) AS gargaml, round(bipartite, 6) AS bipartite, round(stack, 6) AS stack FROM lay")
def _(spark, d):
    return C.layers(_three(spark, d)[2]).select("now", "seed", *[S.rounded(c, 6).alias(c) for c in ("gargaml", "bipartite", "stack")])


@query("ft_boundary_flow_72h", tail("ft_boundary_flow"))
def _(spark, d):
    _, m, inner, _ = _three(spark, d)
    return C.boundary_flow(m, inner, P.totals(R.edges(spark, d), m, DAYS3)).select("now", "seed", *[F.round(c, 4).alias(c) for c in ("ext_in", "ext_out", "conservation")])


#: Sets of one cycle that overlap enough, by number: keys of so many nodes are long.
NUMBERED = """ck AS (SELECT *, row_number() OVER (ORDER BY now, key) AS id FROM cand), ik AS (SELECT c.now, c.id, CAST(c.size AS BIGINT) AS size, m.node FROM ck c JOIN mem2 m USING (now, seed)),
 lki AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM ik x JOIN ik y ON x.now = y.now AND x.node = y.node AND x.id <> y.id GROUP BY x.id, y.id HAVING count(*) >= 0.5 * (any_value(x.size) + any_value(y.size) - count(*))),
 lko AS (SELECT p.now, p.key, q.key AS key_b, shared FROM lki JOIN ck p ON p.id = a JOIN ck q ON q.id = b)"""


@query("gn_overlap_72h", ctes(*TO_CAND, NUMBERED) + "SELECT * FROM lko WHERE key < key_b")
def _(spark, d):
    return C.overlaps(_three(spark, d)[0]).select("now", "key", "key_b", "shared")


@query("gn_suppress_72h", "WITH RECURSIVE " + ",\n".join([*TO_CAND, NUMBERED, re.sub(r"mk AS .*?\n lk AS .*?\n", "lk AS (SELECT * FROM lko),\n", greedy("size DESC, key"), flags=re.S)]))
def _(spark, d):
    return C.suppress(_three(spark, d)[0].withColumn("score", F.col("size").cast("double")))


@query("gn_link_72h", ctes(*TO_TIGHT_CAND, LINK) + SPECS["gn_link"].sql[SPECS["gn_link"].sql.rindex("SELECT now, key_a"):])
def _(spark, d):
    cand, own, _, _ = _tight_candidates(spark, d)
    b = L.bridges(cand, stage(P.pairs_at(R.edges(spark, d), own, DAYS3)), degree=_linked(spark, d)[2])
    return b.select("now", "key_a", "key_b", F.array_join(F.col("bridge").cast("array<string>"), ",").alias("bridge"), F.size("merged").cast("long").alias("n_merged"))


@query("ag_active_rings_72h", tail("ag_active_rings"))
def _(spark, d):
    return _active(spark, d, DAYS3).select("now", "ring", "node", "ring_size")


@query("ev_hits_72h", ctes(*TO_CAND, RINGS, OVER) + "SELECT now, key, ring, shared FROM ov WHERE shared * 1.0 / ring_size >= 0.1 AND shared * 1.0 / (size + ring_size - shared) >= 0.1")
def _(spark, d):
    return E.hits(_three(spark, d)[0], _active(spark, d, DAYS3), 0.1, 0.1)


@query("ev_pk_72h", ctes(*TO_TIGHT_CAND, RINGS, OVER) + "SELECT 10 AS k, CAST(sum(h) AS BIGINT) AS hits, count(*) AS n, round(sum(h) / count(*), 6) AS p FROM (SELECT c.now, c.key, row_number() OVER (PARTITION BY c.now ORDER BY c.size DESC, c.key) AS r, CASE WHEN EXISTS (SELECT 1 FROM ov WHERE ov.now = c.now AND ov.key = c.key AND shared * 1.0 / ring_size >= 0.1 AND shared * 1.0 / (ov.size + ring_size - shared) >= 0.1) THEN 1 ELSE 0 END AS h FROM cand c) WHERE r <= 10")
def _(spark, d):
    cand = _tight_candidates(spark, d)[0]
    found = E.hits(cand, _active(spark, d, DAYS3), 0.1, 0.1).select("now", "key").distinct().withColumn("hit", F.lit(1))
    return E.precision_at(C.top_k(cand, 10, "size").join(found, ["now", "key"], "left").withColumn("hit", F.coalesce("hit", F.lit(0))), 10)


@query("ev_funnel_72h", ctes(*TO_CAND, RINGS, HITS, RANKED, KINDS, FUNNEL) + "SELECT * FROM fn")
def _(spark, d):
    cand = _three(spark, d)[0]
    active = stage(_active(spark, d, DAYS3))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("CYCLE", "FAN-IN", "STACK", "RANDOM")]), (F.pmod("ring", F.lit(4)) + 1).cast("int"))
    return E.funnel(active, active.select("ring").distinct().withColumn("typology", kind), _linked(spark, d)[0], C.ranked(cand, "size"), E.hits(cand, active), 5)


@query("hp_truth_overlap_72h", ctes(*TO_CAND, RINGS, OVER) + "SELECT now, key, ring, shared FROM ov QUALIFY row_number() OVER (PARTITION BY now, key ORDER BY shared DESC, ring) = 1")
def _(spark, d):
    return E.best_overlap(E.overlap(_three(spark, d)[0], _active(spark, d, DAYS3)))


@query("ev_txn_level_72h", tail("ev_txn_level"))
def _(spark, d):
    return E.transaction_level(W.live(R.edges(spark, d), DAYS3), _three(spark, d)[0])


@query("ev_diagnose_reason", ctes(*TO_TIGHT, RINGS, ATTEMPT.replace("at AS", "att AS", 1).replace("at.", "att.").replace("FROM at ", "FROM att ").replace("SELECT ring, shared", "SELECT ring, now, seed, shared").replace("DESC)", "DESC, now, seed)")) + f"""
SELECT ring, round(containment, 6) AS containment, round(jaccard, 6) AS jaccard, CASE WHEN containment < 0.5 THEN 'CONTAINMENT_FAIL' WHEN jaccard < 0.3 THEN 'DILUTION_FAIL' ELSE 'BUILT' END AS verdict, CASE WHEN containment < 0.5 THEN {STOPPED} END AS reason FROM b JOIN traced USING (now, seed)""")
def _(spark, d):
    b = E.diagnosed(_tight(spark, d), _active(spark, d, DAYS3))
    return b.select("ring", F.round("containment", 6).alias("containment"), F.round("jaccard", 6).alias("jaccard"), "verdict", "reason")


COVER = """ic AS (SELECT a.now, a.ring, a.node FROM act a JOIN seeds s ON s.now = a.now AND s.seed = a.node), g1 AS (SELECT DISTINCT i.now, i.ring, o.other AS node FROM ic i JOIN opn o USING (now, node)), gm AS (SELECT * FROM ic UNION SELECT * FROM g1), g2 AS (SELECT DISTINCT i.now, i.ring, o.other AS node FROM g1 i JOIN opn o USING (now, node)),
 gx AS (SELECT * FROM gm UNION SELECT * FROM g2)"""


@query("ev_coverage", ctes(*SHORT_SEEDS, RINGS, "opn AS (SELECT n.* FROM nbrs n JOIN deg USING (now, node) WHERE deg <= 50)", COVER) + "SELECT a.now, a.ring, any_value(ring_size) AS ring_size, CAST(any_value(n) AS INT) AS n_seeds, round(count(gx.node) * 1.0 / any_value(ring_size), 6) AS coverage FROM act a JOIN (SELECT now, ring, count(*) AS n FROM ic GROUP BY ALL) USING (now, ring) LEFT JOIN gx ON gx.now = a.now AND gx.ring = a.ring AND gx.node = a.node GROUP BY a.now, a.ring")
def _(spark, d):
    seeds, nbrs, _ = _seeded(spark, d)
    c = E.coverage(stage(_active(spark, d)), seeds, nbrs)
    return c.withColumn("coverage", S.rounded("coverage", 6))
