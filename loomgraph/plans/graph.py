"""Queries of longer cycles, prunings, seeds by shape, linking and the full feature set."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import candidates as C
from loomgraph.operators import links as L
from loomgraph.operators import shapes as H
from loomgraph.operators import window as W
from loomgraph.operators.stage import stage
from loomgraph.plans.core import _inner, _member, _pairs, EXPAND, TO_CAND, TO_PAIRS, TO_SEEDS, ctes, INNER
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R

#: Directed cycles of up to eight nodes, from the smallest node on; the leg's times make each turn's test a fold.
CYCLE_WALK = """walk AS (SELECT now, seed, src AS s, dst AS hd, [src] AS path, [first_t] AS f, [last_t] AS l FROM inr WHERE src < dst
 UNION ALL SELECT w.now, w.seed, w.s, e.dst, list_append(w.path, e.src), list_append(w.f, e.first_t), list_append(w.l, e.last_t) FROM walk w JOIN inr e ON e.now = w.now AND e.seed = w.seed AND e.src = w.hd WHERE len(w.path) < 8 AND w.hd <> w.s AND NOT list_contains(w.path, w.hd) AND e.dst >= w.s),
 cyc AS (SELECT now, seed, path, f, l FROM walk WHERE hd = s AND len(path) >= 3),
 turn AS (SELECT now, seed, path, list_concat(f[k:], f[:k - 1]) AS f, list_concat(l[k:], l[:k - 1]) AS l FROM cyc, range(1, 9) r(k) WHERE k <= len(path)),
 good AS (SELECT now, seed, path, bool_or(ok) AS timed FROM (SELECT now, seed, path, NOT list_contains([j > 1 AND l[j] < list_max(f[:j - 1]) FOR j IN range(1, len(path) + 1)], true) AS ok FROM turn) GROUP BY ALL),
 cycle_nodes AS (SELECT now, seed, count(DISTINCT n) AS inside, count(DISTINCT CASE WHEN timed THEN n END) AS timed_inside FROM (SELECT now, seed, timed, unnest(path) AS n FROM good) GROUP BY ALL),
 shape AS (SELECT z.now, z.seed, coalesce(n, 0) AS n_cycles, coalesce(sh, 0) AS shortest_cycle, coalesce(mx, 0) AS max_cycle_len, coalesce(inside, 0) AS nodes_in_cycles, coalesce(tn, 0) AS n_temporal, coalesce(tsh, 0) AS shortest_temporal, coalesce(timed_inside, 0) AS nodes_in_temporal
 FROM (SELECT DISTINCT now, seed FROM inr) z LEFT JOIN (SELECT now, seed, count(*) AS n, min(len(path)) AS sh, max(len(path)) AS mx, count(*) FILTER (timed) AS tn, min(len(path)) FILTER (timed) AS tsh FROM good GROUP BY ALL) USING (now, seed) LEFT JOIN cycle_nodes USING (now, seed))"""
REACH = """links AS (SELECT now, seed, src AS a, dst AS b FROM inr UNION SELECT now, seed, dst, src FROM inr),
 reach AS (SELECT DISTINCT now, seed, a AS o, a AS n, 0 AS d FROM links UNION SELECT r.now, r.seed, r.o, k.b, r.d + 1 FROM reach r JOIN links k ON k.now = r.now AND k.seed = r.seed AND k.a = r.n WHERE r.d < 12),
 dist AS (SELECT now, seed, o, n, min(d) AS d FROM reach GROUP BY ALL)"""


def recursive(*parts: str) -> str:
    return ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query("mo_cycles", recursive(*TO_CAND, CYCLE_WALK) + "SELECT now, seed, n_cycles, shortest_cycle, max_cycle_len, nodes_in_cycles FROM shape")
def _(spark, d):
    return H.shapes(_inner(spark, d)[2]).select("now", "seed", "n_cycles", "shortest_cycle", "max_cycle_len", "nodes_in_cycles")


@query("mo_temporal_cycles", recursive(*TO_CAND, CYCLE_WALK) + "SELECT now, seed, n_temporal, shortest_temporal, nodes_in_temporal FROM shape")
def _(spark, d):
    return H.shapes(_inner(spark, d)[2]).select("now", "seed", "n_temporal", "shortest_temporal", "nodes_in_temporal")


@query("gr_components", recursive(*TO_CAND, REACH) + "SELECT now, seed, count(DISTINCT low) AS n_components, max(size) AS largest_component FROM (SELECT now, seed, o, min(n) AS low, count(*) AS size FROM dist GROUP BY ALL) GROUP BY now, seed")
def _(spark, d):
    return H.shapes(_inner(spark, d)[2]).select("now", "seed", "n_components", "largest_component")


@query("gr_diameter", recursive(*TO_CAND, REACH) + "SELECT now, seed, max(d) AS diameter FROM dist GROUP BY now, seed")
def _(spark, d):
    return H.shapes(_inner(spark, d)[2]).select("now", "seed", F.col("diameter").cast("int").alias("diameter"))


def rounds(loose: str, n: int = 12) -> str:
    """Rounds of dropping, unrolled: k0 .. kn over the undirected inner links."""
    sql = ["nb AS (SELECT now, seed, src AS node, dst AS other FROM inr0 UNION SELECT now, seed, dst, src FROM inr0)", "k0 AS (SELECT now, seed, node FROM mem)"]
    for i in range(n):
        sql.append(f"k{i + 1} AS MATERIALIZED (SELECT k.* FROM k{i} k LEFT JOIN (SELECT b.now, b.seed, b.node, count(*) AS deg FROM nb b JOIN k{i} o ON o.now = b.now AND o.seed = b.seed AND o.node = b.other GROUP BY ALL) g USING (now, seed, node) WHERE NOT (coalesce(g.deg, 0) < 2 AND {loose}))")
    last = f"k{n}"
    sql.append(f"big AS (SELECT now, seed FROM {last} GROUP BY ALL HAVING count(*) >= 3), many AS (SELECT now, seed FROM mem GROUP BY ALL HAVING count(*) > 3), good AS (SELECT * FROM big INTERSECT SELECT * FROM many)")
    return ",\n".join(sql) + f"\nSELECT now, seed, node FROM {last} SEMI JOIN good USING (now, seed) UNION ALL SELECT now, seed, node FROM mem ANTI JOIN good USING (now, seed)"


TO_MEM = (*TO_SEEDS, EXPAND, INNER.format(m="mem").replace("inr AS", "inr0 AS", 1))


@query("pr_kcore2", ctes(*TO_MEM, rounds("k.node <> k.seed")))
def _(spark, d):
    m, p = _member(spark, d)
    return H.pruned(m, C.induced(m, p), "kcore2")


@query("pr_near_or_linked", ctes(*TO_MEM, rounds("k.node <> k.seed AND NOT EXISTS (SELECT 1 FROM nb t WHERE t.now = k.now AND t.seed = k.seed AND t.node = k.seed AND t.other = k.node)")))
def _(spark, d):
    m, p = _member(spark, d)
    return H.pruned(m, C.induced(m, p), "near_or_linked")


@query("pr_none", ctes(*TO_SEEDS, EXPAND) + "SELECT now, seed, count(*) AS size FROM mem GROUP BY now, seed")
def _(spark, d):
    return _member(spark, d)[0].groupBy("now", "seed").agg(F.count("*").alias("size"))


@query("mo_mutual", ctes(*TO_CAND) + "SELECT a.now, a.seed, count(*) AS n_mutual FROM inr a JOIN inr b ON a.now = b.now AND a.seed = b.seed AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst GROUP BY a.now, a.seed")
def _(spark, d):
    return C.mutual(_inner(spark, d)[2])


@query("mo_scatter_gather_6h", ctes(*TO_CAND) + "SELECT now, seed, max(w) AS sg FROM (SELECT x.now, x.seed, x.src, y.dst, count(*) AS w FROM inr x JOIN inr y ON x.now = y.now AND x.seed = y.seed AND x.dst = y.src AND x.src <> y.dst AND y.last_t >= x.first_t AND y.first_t <= x.last_t + 360 WHERE NOT EXISTS (SELECT 1 FROM inr z WHERE z.now = x.now AND z.seed = x.seed AND z.src = x.src AND z.dst = y.dst) GROUP BY ALL HAVING count(*) >= 2) GROUP BY now, seed")
def _(spark, d):
    return C.scatter_gather(_inner(spark, d)[2], 360)


@query("mo_gather_scatter", ctes(*TO_CAND) + "SELECT now, seed, max(least(o, i)) AS gs FROM (SELECT now, seed, node, count(*) FILTER (out) AS o, count(*) FILTER (NOT out) AS i FROM (SELECT now, seed, src AS node, true AS out FROM inr UNION ALL SELECT now, seed, dst, false FROM inr) GROUP BY ALL) WHERE o >= 2 AND i >= 2 GROUP BY now, seed")
def _(spark, d):
    return C.fans(_inner(spark, d)[2]).filter("gs >= 2").select("now", "seed", "gs")


@query("gr_invariants", ctes(*TO_PAIRS) + "SELECT 0::BIGINT AS broken, count(*) AS n_nodes FROM (SELECT DISTINCT now, src FROM pairs UNION SELECT now, dst FROM pairs)")
def _(spark, d):
    t = W.node_totals(_pairs(spark, d))
    live = W.live(R.edges(spark, d))
    fresh = live.select("now", F.col("src").alias("node"), F.col("amount").alias("o"), F.lit(0.0).alias("i")).union(live.select("now", "dst", F.lit(0.0), "amount")).groupBy("now", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    j = t.join(fresh, ["now", "node"], "full_outer")
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col(b))), F.lit(True))
    return j.agg(F.sum((off("total_out", "o") | off("total_in", "i")).cast("long")).alias("broken"), F.count("*").alias("n_nodes"))


@query("gr_window_graph", ctes(*TO_PAIRS) + """, born AS (SELECT c.now, count(*) AS added FROM cycles c JOIN edges e ON (CAST(floor(t / 60.0) AS BIGINT) + 1) * 60 <= c.now GROUP BY c.now)
 SELECT now, added, added - n_live AS expired, n_live FROM born JOIN (SELECT now, CAST(sum(cnt) AS BIGINT) AS n_live FROM pairs GROUP BY now) USING (now)""")
def _(spark, d):
    return W.accounts_of_window(R.edges(spark, d))


SMURF = """free AS (SELECT * FROM touched EXCEPT SELECT now, seed FROM seeds), sd AS (SELECT p.now, p.dst AS node, p.src AS other, 's' AS side FROM pairs p JOIN free f ON f.now = p.now AND f.node = p.dst UNION ALL SELECT p.now, p.src, p.dst, 'r' FROM pairs p JOIN free f ON f.now = p.now AND f.node = p.src),
 sz AS (SELECT now, node, count(*) FILTER (side = 's') AS ns, count(*) FILTER (side = 'r') AS nr, count(*) - count(DISTINCT other) AS nb FROM sd GROUP BY ALL),
 pay AS (SELECT a.now, a.node, a.side AS x, b.side AS y, count(DISTINCT a.other) AS k FROM sd a JOIN sd b ON a.now = b.now AND a.node = b.node JOIN pairs p ON p.now = a.now AND p.src = a.other AND p.dst = b.other GROUP BY ALL),
 low AS (SELECT now, node, sum(k * 1.0 / CASE WHEN x = 's' THEN ns ELSE nr END) AS v FROM pay JOIN sz USING (now, node) GROUP BY ALL),
 smurf AS (SELECT now, node, ns + nr AS width, CASE WHEN ns + nr > 50 THEN 0 ELSE greatest(0, 1 - (coalesce(v, 0) + coalesce(nb * 1.0 / nullif(ns, 0), 0) + coalesce(nb * 1.0 / nullif(nr, 0), 0)) / (4 + CAST(ns > 0 AS INT) + CAST(nr > 0 AS INT))) * least(1, (CASE WHEN ns > 0 AND nr > 0 THEN least(ns, nr) ELSE greatest(ns, nr) / 2.0 END) / 5.0) END AS smurf FROM sz LEFT JOIN low USING (now, node))"""
EXTRA = "SELECT now, node AS seed FROM (SELECT x.now, x.node, row_number() OVER (PARTITION BY x.now ORDER BY {by} DESC, x.node) AS rn, budget FROM {pool} x JOIN (SELECT now, floor(count(*) * 0.1) AS budget FROM seeds GROUP BY now) USING (now)) WHERE rn <= budget"


@query("sd_smurf_score", ctes(*TO_SEEDS, SMURF) + "SELECT now, node, width, round(smurf, 6) AS smurf FROM smurf")
def _(spark, d):
    p, e = stage(_pairs(spark, d)), R.edges(spark, d)
    return L.smurf_score(C.untouched_by_rule(e, p), p).withColumn("smurf", F.round("smurf", 6))


#: The same without a bound on width.
SMURF_WIDE = SMURF.replace("CASE WHEN ns + nr > 50 THEN 0 ELSE greatest(0, 1", "greatest(0, 1").replace(" / 5.0) END AS smurf", " / 5.0) AS smurf")


@query("sd_gargaml", ctes(*TO_SEEDS, SMURF_WIDE) + EXTRA.format(by="round(smurf, 9)", pool="smurf"))
def _(spark, d):
    p, e = stage(_pairs(spark, d)), R.edges(spark, d)
    ranked = L.smurf_score(C.untouched_by_rule(e, p), p, max_width=None).select("now", "node", F.round("smurf", 9).alias("by"))
    return C.within_budget(ranked, C.seeds(e, p))


@query("sd_random", ctes(*TO_SEEDS) + ", free AS (SELECT now, node, (node * 2654435761 + now) % 4294967296 AS h FROM (SELECT * FROM touched EXCEPT SELECT now, seed FROM seeds))\n" + EXTRA.format(by="h", pool="free"))
def _(spark, d):
    p, e = stage(_pairs(spark, d)), R.edges(spark, d)
    ranked = C.untouched_by_rule(e, p).withColumn("by", (F.col("node") * 2654435761 + F.col("now")) % 4294967296)
    return C.within_budget(ranked, C.seeds(e, p))


LINK = """ranked AS (SELECT *, row_number() OVER (PARTITION BY now ORDER BY size DESC, key) AS rn FROM cand), m3 AS (SELECT c.now, c.key, m.node FROM ranked c JOIN mem2 m USING (now, seed) WHERE rn <= 200),
 ob AS (SELECT m.now, m.key, p.dst AS x, min(first_t) AS ti FROM m3 m JOIN pairs p ON p.now = m.now AND p.src = m.node JOIN deg ON deg.now = m.now AND deg.node = p.dst AND deg.deg <= 50 WHERE NOT EXISTS (SELECT 1 FROM m3 z WHERE z.now = m.now AND z.key = m.key AND z.node = p.dst) GROUP BY m.now, m.key, p.dst QUALIFY count(*) OVER (PARTITION BY m.now, p.dst) <= 20),
 ib2 AS (SELECT m.now, m.key, p.src AS x, max(last_t) AS t_o FROM m3 m JOIN pairs p ON p.now = m.now AND p.dst = m.node JOIN deg ON deg.now = m.now AND deg.node = p.src AND deg.deg <= 50 WHERE NOT EXISTS (SELECT 1 FROM m3 z WHERE z.now = m.now AND z.key = m.key AND z.node = p.src) GROUP BY m.now, m.key, p.src QUALIFY count(*) OVER (PARTITION BY m.now, p.src) <= 20),
 br AS (SELECT a.now, a.key AS key_a, b.key AS key_b, array_to_string(list(a.x ORDER BY a.x), ',') AS bridge FROM ob a JOIN ib2 b ON a.now = b.now AND a.x = b.x AND a.key <> b.key GROUP BY ALL HAVING count(*) <= 3 AND bool_or(t_o >= ti))"""


@query("gn_link", ctes(*TO_CAND, LINK) + """SELECT now, key_a, key_b, bridge, n AS n_merged FROM (SELECT br.*, (SELECT count(DISTINCT node) FROM m3 WHERE m3.now = br.now AND m3.key IN (key_a, key_b)) AS n, x.size AS sa, y.size AS sb FROM br JOIN cand x ON x.now = br.now AND x.key = key_a JOIN cand y ON y.now = br.now AND y.key = key_b) WHERE n > sa AND n > sb AND n <= 40""")
def _(spark, d):
    cand, _, _, p = _inner(spark, d)
    b = L.bridges(cand, p)
    return b.select("now", "key_a", "key_b", F.array_join(F.col("bridge").cast("array<string>"), ",").alias("bridge"), F.size("merged").cast("long").alias("n_merged"))
