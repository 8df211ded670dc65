"""Queries of the feature set, the score and what is read off it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.operators import candidates as C
from loomgraph.operators import features as X
from loomgraph.operators.stage import once, stage
from loomgraph.plans.core import FLOW, LAYERS, TO_CAND, _inner
from loomgraph.plans.graph import CYCLE_WALK, recursive
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R

LEVELS = "lv AS (SELECT now, seed, node, CASE WHEN max(o) = 1 AND max(i) = 1 THEN 'm' WHEN max(o) = 1 THEN 's' ELSE 'r' END AS l FROM (SELECT now, seed, src AS node, 1 AS o, 0 AS i FROM inr UNION ALL SELECT now, seed, dst, 0, 1 FROM inr) GROUP BY now, seed, node)"
STATS = """acts AS (SELECT src AS node, t, amount AS o, CAST(NULL AS DOUBLE) AS i FROM edges UNION ALL SELECT dst, t, NULL, amount FROM edges),
 asked AS (SELECT DISTINCT now, node FROM mem2), seen AS (SELECT q.now, a.* FROM asked q JOIN acts a ON a.node = q.node AND (CAST(floor(a.t / 60.0) AS BIGINT) + 1) * 60 <= q.now),
 mid AS (SELECT *, avg(o) OVER w AS mo, avg(t / 60.0) OVER w AS mh FROM seen WINDOW w AS (PARTITION BY now, node)),
 raw AS (SELECT now, node, count(o) AS no, count(i) AS ni, count(*) AS n, sum(o) AS so, sum(i) AS si, max(mo) AS mean_o, avg(i) AS mean_i, avg(pow(o - mo, 2)) AS o2, avg(pow(o - mo, 3)) AS o3, avg(pow(o - mo, 4)) AS o4, avg(pow(t / 60.0 - mh, 2)) AS h2, avg(pow(t / 60.0 - mh, 3)) AS h3, avg(pow(t / 60.0 - mh, 4)) AS h4,
 min(least(o, i)) AS lo, max(greatest(o, i)) AS hi, min(t) AS first_t, max(t) AS last_t, max(CASE WHEN o IS NOT NULL THEN t END) AS last_out, min(CASE WHEN i IS NOT NULL THEN t END) AS first_in FROM mid GROUP BY ALL),
 st AS (SELECT *, CASE WHEN no > 0 AND ni > 0 AND si > 0 THEN least(1.0, so / si) ELSE 0 END AS ratio, CASE WHEN no > 0 AND ni > 0 THEN (last_out - first_in) / 60.0 END AS lat, CASE WHEN last_t > first_t THEN n / ((last_t - first_t) / 60.0) ELSE n END AS vel,
 CASE WHEN no > 1 AND o2 > 1e-9 THEN sqrt(o2) ELSE 0 END AS ostd, CASE WHEN no >= 3 AND o2 > 1e-9 THEN o3 / pow(o2, 1.5) ELSE 0 END AS oskew, CASE WHEN no >= 4 AND o2 > 1e-9 THEN o4 / (o2 * o2) - 3 ELSE 0 END AS okurt,
 CASE WHEN n > 1 AND h2 > 1e-9 THEN sqrt(h2) ELSE 0 END AS hstd, CASE WHEN n >= 3 AND h2 > 1e-9 THEN h3 / pow(h2, 1.5) ELSE 0 END AS hskew, CASE WHEN n >= 4 AND h2 > 1e-9 THEN h4 / (h2 * h2) - 3 ELSE 0 END AS hkurt FROM raw),
 ms AS (SELECT now, seed, avg(CASE WHEN ratio >= 0.8 AND lat BETWEEN 0 AND 48 THEN 1.0 ELSE 0 END) AS fast_passthrough_ratio, median(ratio) AS median_passthrough_value, median(first_t / 60.0) AS median_dormancy_h, max(abs(oskew)) AS max_amount_skew, avg(vel) AS mean_velocity, coalesce(avg(mean_o), 0) AS mean_out_amount, coalesce(avg(CASE WHEN no > 0 THEN ostd END), 0) AS mean_amount_std, coalesce(max(CASE WHEN no > 0 THEN abs(okurt) END), 0) AS max_amount_kurtosis, coalesce(avg(mean_i), 0) AS mean_in_amount,
 min(lo) AS min_member_amount, max(hi) AS max_member_amount, avg(hstd) AS mean_time_std_h, avg(hskew) AS mean_time_skew, max(abs(hkurt)) AS max_time_kurtosis FROM mem2 JOIN st USING (now, node) GROUP BY now, seed)"""
OWN = """own AS (SELECT now, seed, count(*) AS n_edges, sum(amount) AS internal, CAST(sum(cnt) AS BIGINT) AS n_txns, sum(CASE WHEN round(amount / cnt, 6) >= 100 AND round(amount / cnt, 6) % 100 = 0 THEN cnt ELSE 0 END) AS n_round, max(last_t) - min(first_t) AS span_minutes FROM inr GROUP BY now, seed HAVING count(*) >= 2),
 fan AS (SELECT now, seed, max(o) AS max_out, max(i) AS max_in, count(*) FILTER (o > 0 AND i > 0) AS n_through, max(least(o, i)) AS gs FROM (SELECT now, seed, node, count(*) FILTER (out) AS o, count(*) FILTER (NOT out) AS i FROM (SELECT now, seed, src AS node, true AS out FROM inr UNION ALL SELECT now, seed, dst, false FROM inr) GROUP BY ALL) GROUP BY now, seed),
 strands AS (SELECT x.now, x.seed, x.src, y.dst, count(*) AS w FROM inr x JOIN inr y ON x.now = y.now AND x.seed = y.seed AND x.dst = y.src AND x.src <> y.dst WHERE NOT EXISTS (SELECT 1 FROM inr z WHERE z.now = x.now AND z.seed = x.seed AND z.src = x.src AND z.dst = y.dst) GROUP BY ALL HAVING count(*) >= 2),
 sgw AS (SELECT now, seed, max(w) AS sg FROM strands GROUP BY now, seed)"""
REG = """typed AS (SELECT m.now, m.seed, m.node, n_name, n_regionkey, c_nationkey || '|' || c_mktsegment AS entity_id, c_mktsegment FROM mem2 m LEFT JOIN customer ON c_custkey = node LEFT JOIN nation ON c_nationkey = n_nationkey),
 reg AS (SELECT now, seed, count(DISTINCT coalesce(n_name, 'Unknown')) AS n_countries, count(DISTINCT n_regionkey) AS n_banks, count(DISTINCT entity_id) AS n_entities, coalesce(count(entity_id) * 1.0 / nullif(count(DISTINCT entity_id), 0), 0) AS entity_reuse FROM typed GROUP BY now, seed),
 dom AS (SELECT now, seed, c_mktsegment AS dominant_entity_type, n * 1.0 / total AS entity_type_purity FROM (SELECT now, seed, c_mktsegment, count(*) AS n, sum(count(*)) OVER (PARTITION BY now, seed) AS total FROM typed WHERE c_mktsegment IS NOT NULL GROUP BY now, seed, c_mktsegment) QUALIFY row_number() OVER (PARTITION BY now, seed ORDER BY n DESC, c_mktsegment) = 1)"""
TERMS = """f AS (SELECT c.now, c.key, c.seed, c.size, own.*EXCLUDE (now, seed), fan.* EXCLUDE (now, seed), shape.* EXCLUDE (now, seed), ms.* EXCLUDE (now, seed), reg.* EXCLUDE (now, seed), coalesce(sg, 0) AS sg, coalesce(gargaml, 0) AS gargaml, coalesce(bipartite, 0) AS bipartite, coalesce(stack, 0) AS stack, ext_in, ext_out,
 CASE WHEN greatest(ext_in, ext_out) > 0 THEN least(ext_in, ext_out) / greatest(ext_in, ext_out) ELSE 0 END AS conservation, n_txns / greatest(1.0, span_minutes / 60.0) AS burstiness, CASE WHEN gs >= 2 THEN gs ELSE 0 END AS gather_scatter, greatest(max_out, max_in) AS max_fan
 FROM cand c JOIN own USING (now, seed) LEFT JOIN fan USING (now, seed) LEFT JOIN shape USING (now, seed) LEFT JOIN ms USING (now, seed) LEFT JOIN reg USING (now, seed) LEFT JOIN sgw USING (now, seed) LEFT JOIN lay USING (now, seed) LEFT JOIN flow USING (now, seed)),
 scored AS (SELECT *, round((0.22 * CASE WHEN n_temporal > 0 THEN 0.6 * nodes_in_temporal / size + CASE WHEN shortest_temporal BETWEEN 1 AND 4 THEN 0.4 ELSE 0 END ELSE 0 END + 0.08 * CASE WHEN n_cycles > 0 THEN 0.6 * nodes_in_cycles / size + CASE WHEN shortest_cycle BETWEEN 1 AND 4 THEN 0.4 ELSE 0 END ELSE 0 END
 + 0.15 * conservation + 0.12 * fast_passthrough_ratio + 0.10 * least(1, sg / 5.0) + 0.05 * least(1, gather_scatter / 5.0) + 0.05 * bipartite + 0.04 * n_through / size + 0.03 * least(1, (n_countries - 1) / 4.0) + 0.01 * least(1, burstiness / 20) + 0.01 * n_round / n_txns) / 0.86, 6) AS score FROM f)"""
TO_SCORE = (*TO_CAND, CYCLE_WALK, FLOW, LEVELS, "lay AS (" + LAYERS + ")", STATS, OWN, REG, TERMS)
MEMBER = ("fast_passthrough_ratio", "median_passthrough_value", "median_dormancy_h", "max_amount_skew", "mean_velocity", "mean_out_amount", "mean_amount_std", "max_amount_kurtosis", "mean_in_amount", "min_member_amount", "max_member_amount", "mean_time_std_h", "mean_time_skew", "max_time_kurtosis")


def built(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate's features, staged once for all queries over the same files."""
    return once(spark, f"{d}/events.parquet", "features", lambda: X.built(R.edges(spark, d), R.registry(spark, d), _inner(spark, d)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """All candidates with at least two inner edges, their contributions and score."""
    f = X.with_score(built(spark, d))
    return f.select("now", "key", "seed", "size", "n_edges", "max_out", "max_in", "sg", F.round("conservation", 6).alias("conservation"), X.typology().alias("typology"), "contrib", "score")


@query("ft_member_stats", recursive(*TO_CAND, STATS) + "SELECT now, seed, " + ", ".join(f"round({c} + 1e-7, 3) AS {c}" for c in MEMBER) + " FROM ms")  # means of cents fall on halves; both sides push them up
def _(spark, d):
    _, member, _, _ = _inner(spark, d)
    return X.member_stats(member, R.edges(spark, d)).na.fill(0).select("now", "seed", *[F.round(F.col(c) + 1e-7, 3).alias(c) for c in MEMBER])


@query("ft_registry", recursive(*TO_CAND, REG) + "SELECT now, seed, n_countries, n_banks, n_entities, round(entity_reuse, 6) AS entity_reuse, dominant_entity_type, round(entity_type_purity, 6) AS entity_type_purity FROM reg LEFT JOIN dom USING (now, seed)")
def _(spark, d):
    _, member, _, _ = _inner(spark, d)
    r = X.registry_features(member, R.registry(spark, d))
    return r.withColumn("entity_reuse", F.round("entity_reuse", 6)).withColumn("entity_type_purity", F.round("entity_type_purity", 6))


WHOLE = ("size", "n_edges", "n_txns", "span_minutes", "max_out", "max_in", "n_through", "gather_scatter", "max_fan", "n_cycles", "shortest_cycle", "n_temporal", "n_countries", "n_banks", "n_entities", "sg")
REAL = ("internal", "ext_in", "ext_out", "conservation", "burstiness", "gargaml", "bipartite", "stack", "entity_reuse", "fast_passthrough_ratio", "mean_velocity")


@query("ft_build", recursive(*TO_SCORE) + "SELECT now, key, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in WHOLE) + ", " + ", ".join(f"round({c}, 3) AS {c}" for c in REAL) + " FROM f")
def _(spark, d):
    return built(spark, d).select("now", "key", *[F.col(c).cast("long").alias(c) for c in WHOLE], *[F.round(c, 3).alias(c) for c in REAL])


@query("ft_score", recursive(*TO_SCORE) + "SELECT now, key, round(score, 4) AS score FROM scored")
def _(spark, d):
    return scored(spark, d).select("now", "key", F.round("score", 4).alias("score"))


@query("fn_typology", recursive(*TO_SCORE) + "SELECT now, key, CASE WHEN n_temporal > 0 THEN 'CYCLE' WHEN stack >= 0.5 THEN 'STACK' WHEN bipartite >= 0.5 THEN 'BIPARTITE' WHEN sg >= 2 THEN 'SCATTER-GATHER' WHEN gather_scatter >= 2 THEN 'GATHER-SCATTER' WHEN max_fan >= 4 THEN 'FAN' ELSE 'CLUSTER' END AS typology FROM f")
def _(spark, d):
    return scored(spark, d).select("now", "key", "typology")


@query("ft_vectorise", recursive(*TO_SCORE) + "SELECT now, key, array_to_string([CAST(size AS BIGINT), n_edges, n_txns, n_cycles, n_temporal, n_countries], ' ') AS vector FROM f")
def _(spark, d):
    columns = ("size", "n_edges", "n_txns", "n_cycles", "n_temporal", "n_countries")
    return built(spark, d).select("now", "key", F.array_join(F.array(*[F.col(c).cast("long") for c in columns]).cast("array<string>"), " ").alias("vector"))


@query("wn_topk_per_cycle", recursive(*TO_SCORE) + "SELECT now, key, CAST(row_number() OVER (PARTITION BY now ORDER BY round(score, 4) DESC, key) AS INT) AS rank FROM scored QUALIFY rank <= 10")
def _(spark, d):
    return C.top_k(scored(spark, d).withColumn("score", F.round("score", 4)), 10).select("now", "key", "rank")


@query("gn_stats", recursive(*TO_SCORE) + "SELECT (SELECT count(*) FROM seeds) AS seeds, (SELECT count(DISTINCT now || ':' || seed) FROM mem) AS expanded, (SELECT count(*) FROM cand) AS deduped, (SELECT count(*) FROM f) AS emitted")
def _(spark, d):
    cand, _, inner, p = _inner(spark, d)
    e = R.edges(spark, d)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    kept = inner.groupBy("now", "seed").count().filter(F.col("count") >= config.MIN_EDGES)
    base = stage(C.seeds(e, p))
    one = n(base, "seeds").withColumn("expanded", F.col("seeds"))  # each seed is a member of its own expansion
    for part in (n(cand, "deduped"), n(kept, "emitted")):  # rows of one
        one = one.join(F.broadcast(part))
    return one
