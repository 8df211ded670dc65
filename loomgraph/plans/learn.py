"""Queries of learning to rank, its terms and Gram matrix, cluster bootstraps, and the cost of wrong labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import candidates as C
from loomgraph.operators import evaluate as E
from loomgraph.operators import features as X
from loomgraph.operators import label_tax as T
from loomgraph.operators import learning as L
from loomgraph.operators import resample
from loomgraph.operators.stage import once, stage
from loomgraph.plans.core import RINGS, TO_SEEDS, _active, _inner, _pairs, ctes
from loomgraph.plans.evaluation import OVER
from loomgraph.plans.features import TO_SCORE, built
from loomgraph.plans.further import DRAW
from loomgraph.plans.graph import recursive
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R

CUT = 30_000  # minutes: earlier cycles are learned from
TREES = 200
FEATURES = ["size", "n_edges", "n_txns", "span_minutes", "max_out", "max_in", "n_through", "n_countries", "n_banks", "n_entities", "internal", "conservation", "burstiness", "fast_passthrough_ratio", "mean_velocity"]
TERM = {
    "temporal_cycle": "CASE WHEN n_temporal > 0 THEN 0.6 * nodes_in_temporal / size + CASE WHEN shortest_temporal BETWEEN 1 AND 4 THEN 0.4 ELSE 0 END ELSE 0 END",
    "conservation": "conservation",
    "fast_passthrough": "fast_passthrough_ratio",
    "scatter_gather": "least(1, sg / 5.0)",
    "gargaml": "greatest(0, gargaml)",
    "cycle": "CASE WHEN n_cycles > 0 THEN 0.6 * nodes_in_cycles / size + CASE WHEN shortest_cycle BETWEEN 1 AND 4 THEN 0.4 ELSE 0 END ELSE 0 END",
    "gather_scatter": "least(1, gather_scatter / 5.0)",
    "bipartite": "bipartite",
    "stack": "stack",
    "passthrough": "n_through * 1.0 / size",
    "cross_border": "least(1, greatest(0, n_countries - 1) / 4.0)",
    "burstiness": "least(1, burstiness / 20)",
    "round_amounts": "n_round * 1.0 / n_txns",
}
TERMS = "tm AS (SELECT now, key, size, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in TERM.items()) + " FROM f)"
LABELS = OVER + ", yl AS (SELECT now, key, CASE WHEN max(shared) >= 2 THEN 1 ELSE 0 END AS y FROM ov GROUP BY now, key), ty AS (SELECT tm.*, coalesce(y, 0) AS y FROM tm LEFT JOIN yl USING (now, key))"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Candidates' features, score terms and a verdict: does it hold two accounts of a ring."""

    def make() -> DataFrame:
        y = E.overlap(_inner(spark, d)[0], _active(spark, d)).groupBy("now", "key").agg((F.max("shared") >= 2).cast("int").alias("y"))
        rows = built(spark, d).select("now", "key", *FEATURES, *[v.cast("double").alias(f"t_{k}") for k, v in X.terms().items()])
        return stage(rows.join(y, ["now", "key"], "left").withColumn("y", F.coalesce("y", F.lit(0))))

    return once(spark, f"{d}/events.parquet", "labelled", make)


def _model(spark: SparkSession, d: str) -> L.Trees:
    return once(spark, f"{d}/events.parquet", "model", lambda: L.fit_any(_labelled(spark, d).filter(F.col("now") < CUT), FEATURES, "y", trees=TREES))


def _held_back(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).filter(F.col("now") >= CUT)


@query("hp_terms_matrix", recursive(*TO_SCORE, TERMS) + "SELECT now, key, " + ", ".join(f"round({k}, 6) AS {k}" for k in TERM) + " FROM tm")
def _(spark, d):
    return built(spark, d).select("now", "key", *[F.round(v.cast("double"), 6).alias(k) for k, v in X.terms().items()])


@query("ml_reranker")
def _(spark, d):
    scored = L.scored(_labelled(spark, d), _model(spark, d))
    part = F.when(F.col("now") < CUT, "train").otherwise("test").alias("part")
    base = scored.groupBy(part).agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.avg("y").alias("base_rate"))
    return base.join(L.average_precision(scored.withColumn("part", part), "p", "y", "part"), "part").withColumn("ap_lift", F.try_divide("ap", "base_rate"))


@query("ml_rank")
def _(spark, d):
    return L.ranked(_held_back(spark, d), _model(spark, d), "key", "now").select("now", "key", "y", "p", "rank")


@query("ml_perm_importance")
def _(spark, d):
    return L.importances(_held_back(spark, d), _model(spark, d), "y")


TERM_NAMES = [*TERM, "y"]


@query("ml_gram", recursive(*TO_SCORE, TERMS, RINGS, LABELS) + "SELECT i, j, round(v, 4) AS v FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum({a} * {b}) AS v FROM ty" for i, a in enumerate(TERM_NAMES) for j, b in enumerate(TERM_NAMES) if i <= j) + ")")
def _(spark, d):
    g = L.gram(_labelled(spark, d), [f"t_{k}" for k in TERM], "y")
    return g.withColumn("v", F.round("v", 4))


@query("ml_nnls")
def _(spark, d):
    weights = L.blend(_labelled(spark, d).filter(F.col("now") < CUT), [f"t_{k}" for k in TERM], "y", one_class=True)
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return _held_back(spark, d).select("now", "key", "y", F.round(score, 6).alias("blend"))


TRIALS = "tr AS (SELECT a.now, a.ring, CAST(max(CASE WHEN s.seed IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS hit, 1::BIGINT AS n FROM act a LEFT JOIN seeds s ON s.now = a.now AND s.seed = a.node GROUP BY a.now, a.ring)"


def _trials(spark: SparkSession, d: str) -> DataFrame:
    """Per cycle and ring: is one of its accounts a seed."""
    p = stage(_pairs(spark, d))
    s = C.seeds(R.edges(spark, d), p).select("now", F.col("seed").alias("node"), F.lit(1).alias("s"))
    return stage(_active(spark, d).join(s, ["now", "node"], "left").groupBy("now", "ring").agg(F.max(F.coalesce("s", F.lit(0))).alias("hit"), F.lit(1).alias("n")))


def clustered(key: str) -> str:
    return f"""k_{key} AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS i FROM (SELECT {key}, sum(hit) AS h, sum(n) AS m FROM tr GROUP BY {key})), n_{key} AS (SELECT count(*) AS n FROM k_{key}),
 d_{key} AS (SELECT r, sum(h) * 1.0 / sum(m) AS v FROM (SELECT r, {DRAW} % n AS i FROM range(0, 2000) x(r), n_{key}, range(0, 100000) y(j) WHERE j < n) JOIN k_{key} USING (i) GROUP BY r),
 b_{key} AS (SELECT '{key}' AS clustering, list_sort(list(v))[51] AS low, list_sort(list(v))[1951] AS high, (SELECT n FROM n_{key}) AS n_clusters FROM d_{key})"""


@query("ev_bootstrap", ctes(*TO_SEEDS, RINGS, TRIALS, clustered("now")) + "SELECT clustering, (SELECT sum(hit) * 1.0 / sum(n) FROM tr) AS point, round(low, 6) AS low, round(high, 6) AS high, n_clusters FROM b_now")
def _(spark, d):
    b = resample.cluster_bootstrap(_trials(spark, d), ["now"], "hit", "n").filter("clustering = 'now'")
    return b.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("ev_two_way_cluster", ctes(*TO_SEEDS, RINGS, TRIALS, clustered("now"), clustered("ring"), "two AS (SELECT * FROM b_now UNION ALL SELECT * FROM b_ring)") + "SELECT clustering, (SELECT sum(hit) * 1.0 / sum(n) FROM tr) AS point, round(low, 6) AS low, round(high, 6) AS high, n_clusters FROM (SELECT * FROM two UNION ALL SELECT 'all', min(low), max(high), min(n_clusters) FROM two)")
def _(spark, d):
    b = resample.cluster_bootstrap(_trials(spark, d), ["now", "ring"], "hit", "n")
    return b.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


#: Customers as labelled cases: a verdict that their balance and nation bear on, a cell of both, a cycle.
CASES = "cs AS (SELECT c_custkey AS id, c_custkey % 30 AS cycle, c_custkey % 30 < 18 AS train, floor(c_acctbal / 1000) * 25 + c_nationkey AS cell, CASE WHEN (c_acctbal > 4000 AND c_custkey % 3 <> 0) OR c_nationkey % 7 = 0 AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS y FROM customer)"
HASH = "((id * 7919 + {seed} * 104729 + 7) % 2147483647)"
for _step in range(3):
    HASH = f"(({HASH} * 48271 + 11) % 2147483647)"
ARMS = f"""arms AS (SELECT rate, seed, kind FROM (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5]) AS rate), (SELECT unnest([0, 1, 2]) AS seed), (SELECT unnest(['raw', 'control']) AS kind)),
 lab AS (SELECT a.rate, a.seed, a.kind, id, cell, y AS was, CASE WHEN y = 1 AND {HASH.format(seed="seed")} / 2147483647.0 < rate THEN CASE WHEN kind = 'raw' THEN 0 END ELSE y END AS y FROM arms a, cs WHERE train)"""
CELLS = """cl AS (SELECT rate, seed, kind, cell, (sum(y) + 1.0) / (count(y) + 2.0) AS p FROM lab GROUP BY ALL), all_p AS (SELECT rate, seed, kind, (sum(y) + 1.0) / (count(y) + 2.0) AS p FROM lab GROUP BY ALL),
 sc AS (SELECT a.rate, a.seed, a.kind, t.cycle, t.id, t.y, round(coalesce(c.p, a.p), 9) AS p FROM all_p a JOIN (SELECT * FROM cs WHERE NOT train) t ON true LEFT JOIN cl c ON c.rate = a.rate AND c.seed = a.seed AND c.kind = a.kind AND c.cell = t.cell),
 ht AS (SELECT rate, seed, kind, cycle, CAST(sum(y) AS BIGINT) AS hit, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY rate, seed, kind, cycle ORDER BY p DESC, id) AS r FROM sc) WHERE r <= 10 GROUP BY ALL)"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    y = ((F.col("c_acctbal") > 4000) & (k % 3 != 0)) | ((F.col("c_nationkey") % 7 == 0) & (k % 2 == 0))
    return c.select(k.alias("id"), (k % 30).alias("cycle"), (k % 30 < 18).alias("train"), (F.floor(F.col("c_acctbal") / 1000) * 25 + F.col("c_nationkey")).alias("cell"), y.cast("int").alias("y"))


RATES = (0.0, 0.1, 0.2, 0.3, 0.5)


def _noise(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every arm and cycle."""
    return once(spark, f"{d}/customer.parquet", "noise", lambda: stage(T.arm_hits(T.relabelled(_cases(spark, d).filter("train"), RATES), _cases(spark, d).filter("not train"))))


@query("ev_label_noise", ctes(CASES, ARMS, CELLS) + "SELECT rate, seed, kind, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS n FROM ht GROUP BY ALL")
def _(spark, d):
    return _noise(spark, d).groupBy("rate", "seed", "kind").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))


@query("hp_label_tax_rows", ctes(CASES, ARMS) + "SELECT rate, seed, kind, CAST(sum(was - coalesce(y, 0)) AS BIGINT) AS n_flipped, count(y) AS n_train, CAST(sum(y) AS BIGINT) AS n_positive FROM lab GROUP BY ALL")
def _(spark, d):
    lab = T.relabelled(_cases(spark, d).filter("train"), RATES)
    return lab.groupBy("rate", "seed", "kind").agg(F.sum(F.col("was") - F.coalesce("y", F.lit(0))).alias("n_flipped"), F.count("y").alias("n_train"), F.sum("y").alias("n_positive"))


BUDGET = f"""fr AS (SELECT f AS rate, seed, 'budget' AS kind FROM (SELECT unnest([0.05, 0.2, 0.5, 1.0]) AS f), (SELECT unnest([0, 1, 2]) AS seed)), lab AS (SELECT a.rate, a.seed, a.kind, id, cell, y AS was, CASE WHEN {HASH.format(seed="seed")} / 2147483647.0 < rate THEN y END AS y FROM fr a, cs WHERE train)"""


@query("ev_label_budget", ctes(CASES, BUDGET, CELLS) + "SELECT rate, seed, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS n FROM ht GROUP BY ALL")
def _(spark, d):
    hits = T.arm_hits(T.budgeted(_cases(spark, d).filter("train"), (0.05, 0.2, 0.5, 1.0)), _cases(spark, d).filter("not train"))
    return hits.groupBy("rate", "seed").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))


SLOPES = f"""pc AS (SELECT rate, kind, cycle, sum(hit) AS hit, sum(n) AS n FROM ht GROUP BY ALL), cyc AS (SELECT cycle, row_number() OVER (ORDER BY cycle) - 1 AS i FROM (SELECT DISTINCT cycle FROM pc)), nc AS (SELECT count(*) AS n FROM cyc),
 dr AS (SELECT r, cycle FROM (SELECT r, {DRAW} % n AS i FROM range(0, 2000) x(r), nc, range(0, 100000) y(j) WHERE j < n) JOIN cyc USING (i)),
 pk AS (SELECT r, kind, rate, sum(hit) * 1.0 / sum(n) AS p FROM (SELECT * FROM dr UNION ALL SELECT -1, cycle FROM cyc) JOIN pc USING (cycle) GROUP BY ALL),
 sl AS (SELECT r, kind, regr_slope(p, rate) AS s FROM pk GROUP BY r, kind), tax AS (SELECT a.r, 'tax' AS kind, a.s - b.s AS s FROM sl a JOIN sl b ON a.r = b.r AND a.kind = 'raw' AND b.kind = 'control'), every AS (SELECT * FROM sl UNION ALL SELECT * FROM tax)"""


@query("ev_slope_ci", ctes(CASES, ARMS, CELLS, SLOPES) + "SELECT kind, round(max(s) FILTER (r < 0), 5) AS slope, round(list_sort(list(s) FILTER (r >= 0))[51], 5) AS low, round(list_sort(list(s) FILTER (r >= 0))[1951], 5) AS high, (SELECT n FROM nc) AS n_units FROM every GROUP BY kind")
def _(spark, d):
    s = T.slopes(_noise(spark, d))
    return s.select("kind", *[F.round(c, 5).alias(c) for c in ("slope", "low", "high")], "n_units")


@query("ev_required_n", ctes(CASES, ARMS, CELLS) + """, per AS (SELECT rate, seed, kind, sum(hit) * 1.0 / sum(n) AS p FROM ht GROUP BY ALL), sp AS (SELECT kind, rate, max(p) - min(p) AS spread, avg(p) AS p FROM per GROUP BY ALL), z AS (SELECT kind, p AS p0 FROM sp WHERE rate = 0)
 SELECT kind, rate, round(spread, 6) AS spread, round(p - p0, 6) AS effect, CASE WHEN abs(p - p0) > 1e-12 THEN CAST(ceil((SELECT count(DISTINCT cycle) FROM ht) * pow(spread / abs(p - p0), 2) - 1e-9) AS BIGINT) END AS n FROM sp JOIN z USING (kind) WHERE rate > 0""")
def _(spark, d):
    n = T.required(_noise(spark, d))
    return n.select("kind", "rate", F.round("spread", 6).alias("spread"), F.round("effect", 6).alias("effect"), "n")
