"""The three-day window, sinks, siblings, memberships and resampled intervals, with their oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions import scalars as S
from loomgraph.operators import candidates as C
from loomgraph.operators import resample
from loomgraph.operators import window as W
from loomgraph.plans.core import CYCLES, DEG, EDGES, ISLANDS, LIVE, NBRS, PAIRS, SEEDS, TEND, THROUGH, TOUCHED, ctes
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R
from loomgraph.sources import sinks

DAYS3 = 4320
LONG = (EDGES, CYCLES.replace(">= 180", ">= 2160"), ISLANDS.replace("<= 360", "<= 4320"), LIVE.replace("- 360", "- 4320"), PAIRS)


def _live(spark: SparkSession, d: str) -> DataFrame:
    return W.live(W.islands(R.edges(spark, d), DAYS3, rows=spark.read.parquet(f"{d}/events.parquet").count()), DAYS3)


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("flt_window_72h", ctes(*LONG[:-1]) + "SELECT now, seq, t, island_first FROM live")
def _(spark, d):
    return _live(spark, d).select("now", "seq", "t", "island_first")


@query("ag_pair_72h", ctes(*LONG) + "SELECT now, src, dst, cnt, round(amount, 4) AS amount, first_t, last_t FROM pairs")
def _(spark, d):
    return W.pairs(_live(spark, d)).withColumn("amount", F.round("amount", 4))


@query("gr_neighbours_72h", ctes(*LONG, NBRS, DEG) + "SELECT now, node, deg FROM deg")
def _(spark, d):
    return W.neighbours(W.pairs(_live(spark, d))).groupBy("now", "node").agg(F.count("*").alias("deg"))


@query("sd_passthrough_72h", ctes(*LONG, NBRS, DEG, TOUCHED, THROUGH, SEEDS) + "SELECT now, seed FROM seeds")
def _(spark, d):
    return C.seeds(R.edges(spark, d), W.pairs(_live(spark, d)))


@query("fn_country_names", "SELECT n_nationkey, CASE WHEN c = 'Crytpo' THEN 'Crypto' WHEN c IN (" + ", ".join(f"'{c}'" for c in config.COUNTRIES) + ") THEN c ELSE 'USA' END AS country, CASE WHEN n_nationkey % 4 = 0 THEN 'Unknown' ELSE n_name END AS entity_type FROM (SELECT *, CASE WHEN n_nationkey % 5 = 0 THEN 'Crytpo' ELSE array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS c FROM nation)")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    bank = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "Crytpo").otherwise(F.initcap("n_name")), F.lit(" Bank #3"))
    owner = F.when(F.col("n_nationkey") % 4 == 0, " #9").otherwise(F.concat("n_name", F.lit(" #12")))
    return n.select("n_nationkey", S.country(bank).alias("country"), S.entity_type(owner).alias("entity_type"))


@query("fn_cross_bank", ctes(EDGES) + "SELECT seq, a.n_regionkey <> b.n_regionkey AS cross_bank FROM edges JOIN (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) a ON a.c_custkey = src JOIN (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) b ON b.c_custkey = dst")
def _(spark, d):
    r = R.registry(spark, d).select("key", S.account_key(F.col("bank").cast("string"), F.col("key").cast("string")).alias("account"))
    e = R.edges(spark, d).join(r.toDF("src", "src_key"), "src").join(r.toDF("dst", "dst_key"), "dst")
    return e.select("seq", S.crosses(S.bank_of(F.col("src_key")), S.bank_of(F.col("dst_key"))).alias("cross_bank"))


@query("fn_cross_currency", "SELECT l_orderkey, l_linenumber, l_returnflag <> l_linestatus AS cross_currency FROM lineitem")
def _(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", S.crosses(F.col("l_returnflag"), F.col("l_linestatus")).alias("cross_currency"))


@query("jn_siblings", "SELECT c_custkey AS key, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1 AS n_siblings FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    r = R.registry(spark, d)
    size = r.groupBy("entity_id").agg((F.count("*") - 1).alias("n_siblings"))
    return r.join(size, "entity_id").select("key", "n_siblings")


@query("jn_induced_semi", ctes(EDGES) + "SELECT seq, src, dst FROM edges WHERE src IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND dst IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def _(spark, d):
    inside = spark.read.parquet(f"{d}/customer.parquet").filter("c_nationkey < 12").select("c_custkey")
    return W.induced_by(R.edges(spark, d), inside).select("seq", "src", "dst")


@query("jn_cluster_member", ctes(EDGES) + "SELECT node, min(ring) AS cluster, count(DISTINCT ring) AS n_clusters FROM (SELECT src % 20 AS ring, src AS node FROM edges WHERE label = 1 UNION ALL SELECT src % 20, dst FROM edges WHERE label = 1) GROUP BY node")
def _(spark, d):
    r = R.rings(spark, d)
    m = r.select("ring", F.explode(F.array("src", "dst")).alias("node"))
    return m.groupBy("node").agg(F.min("ring").alias("cluster"), F.count_distinct("ring").alias("n_clusters"))


@query("src_count_rings", ctes(EDGES) + "SELECT count(DISTINCT src % 20) AS n_rings, count(*) AS n_edges FROM edges WHERE label = 1")
def _(spark, d):
    return R.rings(spark, d).agg(F.count_distinct("ring").alias("n_rings"), F.count("*").alias("n_edges"))


@query("wn_sort_stable", ctes(EDGES) + f"SELECT seq, {TEND} AS tick_end, row_number() OVER (PARTITION BY {TEND} ORDER BY t, seq) AS place FROM edges")
def _(spark, d):
    e = R.edges(spark, d).withColumn("tick_end", S.tick_end(F.col("t")))
    return e.select("seq", "tick_end", F.row_number().over(Window.partitionBy("tick_end").orderBy("t", "seq")).cast("long").alias("place"))


@query("st_n_ticks", ctes(EDGES) + f"SELECT CAST((max({TEND}) - min({TEND})) / 60 + 1 AS BIGINT) AS n_ticks, count(DISTINCT {TEND}) AS n_filled FROM edges")
def _(spark, d):
    end = S.tick_end(F.col("t"))
    return R.edges(spark, d).agg(((F.max(end) - F.min(end)) / config.TICK + 1).cast("long").alias("n_ticks"), F.count_distinct(end).alias("n_filled"))


@query("snk_parquet", ctes(EDGES) + "SELECT seq, src, dst, t, round(amount, 2) AS amount, channel, label FROM edges")
def _(spark, d):
    return sinks.write_stream_table(R.edges(spark, d), _folder(spark, "stream")).withColumn("amount", F.round("amount", 2))


@query("snk_event_append", "SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status FROM orders")
def _(spark, d):
    path = _folder(spark, "events")
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("case_id"))
    sinks.append_events(o.select("case_id", F.lit("OPEN").alias("status"), F.lit(1).alias("at")), path)
    sinks.append_events(o.filter("case_id % 3 = 0").select("case_id", F.lit("CLOSED").alias("status"), F.lit(2).alias("at")), path)
    return R.latest_events(spark, path, "case_id", "at").select("case_id", "status")


DRAW = "((r * 7919 + j * 104729 + 7) % 2147483647)"
for _step in range(3):
    DRAW = f"(({DRAW} * 48271 + 11) % 2147483647)"


@query("ev_paired_bootstrap", ctes(EDGES) + f""", u AS (SELECT day, a - b AS d, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT CAST(floor(t / 1440.0) AS BIGINT) AS day, avg(CASE WHEN amount > 60 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0 END) AS b FROM edges GROUP BY 1)),
 n AS (SELECT count(*) AS n, avg(d) AS diff FROM u), dr AS (SELECT r, {DRAW} % n AS i FROM range(0, 2000) x(r), n, range(0, 1000) y(j) WHERE j < n), m AS (SELECT r, avg(d) AS m FROM dr JOIN u USING (i) GROUP BY r)
SELECT round(diff, 6) AS diff, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, n FROM m, n GROUP BY diff, n""")
def _(spark, d):
    e = R.edges(spark, d).groupBy(F.floor(F.col("t") / 1440).alias("day")).agg(F.avg((F.col("amount") > 60).cast("double")).alias("a"), F.avg((F.col("label") == 1).cast("double")).alias("b"))
    return resample.paired_bootstrap(e, "day", "a", "b").select(*[F.round(c, 6).alias(c) for c in ("diff", "low", "high")], "n")


@query("ev_best_single_feature", "SELECT feature, round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 6) AS auc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT feature, v, sum(y) AS p, sum(1 - y) AS q FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE)]) AS v FROM lineitem) GROUP BY 1, 2)) GROUP BY feature")
def _(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return resample.best_single_feature(x, ["l_quantity", "l_extendedprice", "l_discount"], "y").select("feature", F.round("auc", 6).alias("auc"))
