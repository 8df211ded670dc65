"""Queries of the streaming replay: ticks, quiet ones too, accounts' state and late rows, with batch oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.stage import once
from loomgraph.plans.core import EDGES, TEND, ctes
from loomgraph.plans.further import _folder
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R
from loomgraph.streaming import replay as P

CALENDAR = f"tk AS (SELECT {TEND} AS tick_end, count(*) AS n, sum(amount) AS amount FROM {{rows}} GROUP BY 1), cal AS (SELECT unnest(range(min(tick_end), max(tick_end) + 1, 60)) AS tick_end FROM tk)"
QUIET = "SELECT tick_end, coalesce(n, 0) AS n, round(coalesce(amount, 0), 2) AS amount FROM cal LEFT JOIN tk USING (tick_end)"


def _sparse(edges: DataFrame) -> DataFrame:
    """Edges of every third hour, for quiet ticks."""
    return edges.filter(F.floor(F.col("t") / 60) % 3 == 0)


def _replayed(spark: SparkSession, d: str, name: str, edges: DataFrame, query_name: str, number: int) -> tuple[str, list[int]]:
    def make() -> tuple[str, list[int]]:
        folder = _folder(spark, name)
        return folder, P.replay(spark, edges, folder, (query_name,), number)[query_name]

    return once(spark, f"{d}/events.parquet", name, make)


@query("st_tumbling", ctes(EDGES) + f"SELECT {TEND} AS tick_end, count(*) AS n, round(sum(amount), 2) AS amount FROM edges GROUP BY 1")
def _(spark, d):
    folder, _ = _replayed(spark, d, "ticks", R.edges(spark, d), "ticks", 1)
    return P.ticks(spark, folder).filter("n > 0").withColumn("amount", F.round("amount", 2))


@query("st_quiet_ticks", ctes(EDGES, "sparse AS (SELECT * FROM edges WHERE CAST(floor(t / 60.0) AS BIGINT) % 3 = 0)", CALENDAR.format(rows="sparse")) + QUIET)
def _(spark, d):
    folder, _ = _replayed(spark, d, "quiet", _sparse(R.edges(spark, d)), "ticks", 2)
    return P.ticks(spark, folder).withColumn("amount", F.round("amount", 2))


SHAPES = """SELECT node, n AS {k}_n, round(m + 1e-7, 4) AS {k}_mean, round(CASE WHEN n > 1 THEN m2 ELSE 0 END, 2) AS {k}_var, round(CASE WHEN n >= 3 AND m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END, 4) AS {k}_skew, round(CASE WHEN n >= 4 AND m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, 4) AS {k}_kurt
 FROM (SELECT node, count(*) AS n, max(m) AS m, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM (SELECT *, avg(x) OVER (PARTITION BY node) AS m FROM ({rows})) GROUP BY node)"""
SIDES = {"out": "SELECT src AS node, amount AS x FROM edges", "in": "SELECT dst AS node, amount AS x FROM edges", "time": "SELECT src AS node, CAST(t AS DOUBLE) AS x FROM edges UNION ALL SELECT dst, CAST(t AS DOUBLE) FROM edges"}
MARKS = "mk AS (SELECT node, min(t) AS first_t, max(t) AS last_t, max(CASE WHEN o THEN t END) AS last_out, min(CASE WHEN NOT o THEN t END) AS first_in, round(sum(CASE WHEN o THEN a ELSE 0 END), 2) AS out_total, round(sum(CASE WHEN o THEN 0 ELSE a END), 2) AS in_total FROM (SELECT src AS node, t, true AS o, amount AS a FROM edges UNION ALL SELECT dst, t, false, amount FROM edges) GROUP BY node)"
COLUMNS = [f"{k}_{c}" for k in SIDES for c in ("n", "mean", "var", "skew", "kurt")]


@query("st_state", ctes(EDGES, MARKS, *[f"{k}_s AS ({SHAPES.format(k=k, rows=rows)})" for k, rows in SIDES.items()]) + "SELECT mk.*, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COLUMNS) + " FROM mk LEFT JOIN out_s USING (node) LEFT JOIN in_s USING (node) LEFT JOIN time_s USING (node)")
def _(spark, d):
    folder, _ = _replayed(spark, d, "accounts", R.edges(spark, d), "accounts", 3)
    digits = {"mean": 4, "var": 2, "skew": 4, "kurt": 4, "total": 2}
    a = P.accounts(spark, folder)
    return a.select("node", "first_t", "last_t", "last_out", "first_in", *[F.round(F.col(c) + (1e-7 if c.endswith("_mean") else 0), digits[c.split("_")[1]]).alias(c) if c.split("_")[1] in digits else c for c in ("out_total", "in_total", *COLUMNS)])  # means of cents fall on halves; both sides push them up


#: Three slices of time; every 97th edge comes with the last. Late is what is at or behind the watermark: an hour before the newest edge of earlier slices.
ARRIVALS = """arr AS (SELECT *, CASE WHEN seq % 97 = 0 THEN 2 ELSE CAST(floor((t - lo) * 3 / (hi - lo + 1)) AS BIGINT) END AS slice FROM edges, (SELECT min(t) AS lo, max(t) AS hi FROM edges)),
 lt AS (SELECT *, slice = 2 AND t <= (SELECT max(t) FROM arr WHERE slice < 2) - 60 AS late FROM arr)"""


def _late(spark: SparkSession, d: str) -> tuple[str, list[int]]:
    _, _, cut = P.slices(R.edges(spark, d), 3)
    return _replayed(spark, d, "late", cut.withColumn("slice", F.when(F.col("seq") % 97 == 0, 2).otherwise(F.col("slice"))), "ticks", 3)


@query("st_late", ctes(EDGES, ARRIVALS) + "SELECT slice, CAST(sum(CAST(late AS INT)) AS BIGINT) AS n_late FROM lt GROUP BY slice")
def _(spark, d):
    _, late = _late(spark, d)
    return spark.createDataFrame(list(enumerate(late)), "slice long, n_late long")  # a row per run of the query


@query("st_watermark", ctes(EDGES, ARRIVALS, CALENDAR.format(rows="(SELECT * FROM lt WHERE NOT late)")) + QUIET)
def _(spark, d):
    folder, _ = _late(spark, d)
    return P.ticks(spark, folder).withColumn("amount", F.round("amount", 2))
