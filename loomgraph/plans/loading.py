"""Queries of the loaders: compiled stream, labelled patterns, static graphs. Their files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators.stage import once, stage
from loomgraph.plans.core import EDGES, ctes
from loomgraph.plans.further import _folder
from loomgraph.plans.registry import query
from loomgraph.sources import compile as K
from loomgraph.sources import patterns as N
from loomgraph.sources import readers as R
from loomgraph.sources import static_graph as G

RAW = """raw AS (SELECT event_id AS seq, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS t, (user_id % 7) || ':' || user_id AS src, (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 7) || ':' || CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS dst, value AS amount, event_type AS channel, CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS label, CASE WHEN event_type = 'error' AND value > 60 THEN user_id % 20 ELSE -1 END AS ring FROM events),
 ids AS (SELECT key, dense_rank() OVER (ORDER BY pos) - 1 AS id FROM (SELECT key, min(pos) AS pos FROM (SELECT src AS key, 2 * seq AS pos FROM raw UNION ALL SELECT dst, 2 * seq + 1 FROM raw) GROUP BY key)),
 chs AS (SELECT channel, dense_rank() OVER (ORDER BY min(seq)) - 1 AS id FROM raw GROUP BY channel)"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Events as transactions with accounts' keys, self-loops included."""
    e = spark.read.parquet(f"{d}/events.parquet")
    other = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    key = lambda c: F.concat_ws(":", (c % 7).cast("string"), c.cast("string"))
    suspect = (F.col("event_type") == "error") & (F.col("value") > 60)
    minutes = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) - 28_401_120).cast("long")
    return e.select(F.col("event_id").alias("seq"), minutes.alias("t"), key(F.col("user_id")).alias("src"), key(other).alias("dst"), F.col("value").alias("amount"), F.col("event_type").alias("channel"), suspect.cast("int").alias("label"), F.when(suspect, F.col("user_id") % 20).otherwise(-1).alias("ring"))


def _compiled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return once(spark, f"{d}/events.parquet", "compiled", lambda: K.compile_stream(_raw(spark, d), _folder(spark, "compiled")))


@query("src_compile_stream", "WITH " + RAW + " SELECT seq, t, a.id AS src, b.id AS dst, round(amount, 2) AS amount, chs.id AS channel, label, ring FROM raw JOIN ids a ON a.key = src JOIN ids b ON b.key = dst JOIN chs USING (channel) WHERE src <> dst")
def _(spark, d):
    return _compiled(spark, d)[0].withColumn("amount", F.round("amount", 2))


@query("src_compile_nodes", "WITH " + RAW + " SELECT key, id FROM ids")
def _(spark, d):
    return _compiled(spark, d)[1]


@query("src_compile_meta", "WITH " + RAW + " SELECT count(*) AS n_rows, count(*) FILTER (src = dst) AS n_self_loops, count(*) FILTER (src <> dst) AS n_edges, count(*) FILTER (ring >= 0) AS n_ring_edges, min(t) AS t_min, max(t) AS t_max, (SELECT count(*) FROM ids) AS n_nodes FROM raw")
def _(spark, d):
    return _compiled(spark, d)[2]


def sliced(low: int, high: int, most: int) -> str:
    return f"""cut AS (SELECT *, CASE WHEN label = 1 THEN src % 20 ELSE -1 END AS ring FROM edges WHERE t >= {low} AND t < {high}), rn AS (SELECT src AS node FROM cut WHERE ring >= 0 UNION SELECT dst FROM cut WHERE ring >= 0),
 kn AS (SELECT node FROM rn UNION SELECT src FROM cut WHERE dst IN (FROM rn) OR src IN (FROM rn) UNION SELECT dst FROM cut WHERE dst IN (FROM rn) OR src IN (FROM rn)), tc AS (SELECT * FROM cut WHERE src IN (FROM kn) OR dst IN (FROM kn)),
 st AS (SELECT count(*) AS n, count(*) FILTER (ring >= 0) AS l FROM tc), bg AS (SELECT *, row_number() OVER (ORDER BY t, seq) - 1 AS i FROM tc WHERE ring < 0),
 th AS (SELECT seq, src, dst, t, amount, ring FROM tc WHERE ring >= 0 UNION ALL SELECT seq, src, dst, t, amount, ring FROM bg, st WHERE n <= {most} OR (i % greatest(1, (n - l) // greatest(1, {most} - l)) = 0 AND i // greatest(1, (n - l) // greatest(1, {most} - l)) < {most} - l)),
 dn AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT src AS key FROM th UNION SELECT dst FROM th))"""


def _slice(spark: SparkSession, d: str, most: int) -> tuple[DataFrame, DataFrame]:
    e = R.edges(spark, d).withColumn("ring", F.when(F.col("label") == 1, F.col("src") % 20).otherwise(-1)).select("seq", "src", "dst", "t", "amount", "ring")
    return once(spark, f"{d}/events.parquet", f"slice-{most}", lambda: K.fixture_slice(e, 1440, 10_080, most))


@query("src_fixture_slice", ctes(EDGES, sliced(1440, 10_080, 900)) + "SELECT seq, a.id AS src, b.id AS dst, t, round(amount, 2) AS amount, ring FROM th JOIN dn a ON a.key = src JOIN dn b ON b.key = dst")
def _(spark, d):
    return _slice(spark, d, 900)[0].withColumn("amount", F.round("amount", 2))


@query("src_fixture_nodes", ctes(EDGES, sliced(1440, 10_080, 150_000)) + "SELECT key, id FROM dn")
def _(spark, d):
    return _slice(spark, d, 150_000)[1]


#: A block per labelled account: every fifth has no END, every seventh a wrong one; every ninth edge lacks a column; a row after the last END of some.
BLOCKS = f"""lab AS (SELECT * FROM edges WHERE label = 1), bl AS (SELECT src AS b, count(*) AS n, count(*) FILTER (seq % 9 = 0) AS bad FROM lab GROUP BY src),
 good AS (SELECT src AS b, seq, src, dst, t, amount FROM lab WHERE seq % 9 <> 0)"""
TYPES = ("CYCLE", "FAN-IN", "STACK", "RANDOM")
NAMED = "CASE b % 4 WHEN 0 THEN 'CYCLE' WHEN 1 THEN 'FAN-IN' WHEN 2 THEN 'STACK' ELSE 'RANDOM' END"


def _pattern_file(spark: SparkSession, d: str) -> str:
    """Blocks of labelled edges as text, anomalies among them, in several files."""
    e = R.edges(spark, d).filter("label = 1")
    when = F.date_format(F.timestamp_seconds((F.col("t") + 28_401_120) * 60), "yyyy/MM/dd HH:mm")
    amount = F.format_string("%.2f", "amount")
    text = F.concat_ws(",", when, F.lit("007"), F.col("src").cast("string"), F.lit("0"), F.col("dst").cast("string"), amount, F.lit("Euro"), amount, F.lit("Euro"), "channel", F.when(F.col("seq") % 9 != 0, F.lit("1")))
    rows = e.select(F.col("src").alias("b"), F.lit(1).alias("part"), "seq", text.alias("value"))
    kind = F.element_at(F.array(*[F.lit(k) for k in TYPES]), (F.col("b") % 4 + 1).cast("int"))
    block = e.select(F.col("src").alias("b")).distinct()
    begin = block.select("b", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), kind, F.lit(": account "), F.col("b").cast("string")).alias("value"))
    end = block.filter("b % 5 <> 0").select("b", F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("END LAUNDERING ATTEMPT - "), F.when(F.col("b") % 7 == 0, "OTHER").otherwise(kind)).alias("value"))
    stray = block.filter("b % 5 <> 0 and b % 11 = 0").select("b", F.lit(3).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("a line of no block").alias("value"))
    path = f"{_folder(spark, 'patterns')}/text"
    rows.union(begin).union(end).union(stray).repartitionByRange(4, "b").sortWithinPartitions("b", "part", "seq").select("value").write.text(path)
    return path


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, f"{d}/events.parquet", "patterns", lambda: stage(N.read_lines(spark, _pattern_file(spark, d), 1 << 12)))


@query("src_patterns", ctes(EDGES, BLOCKS) + f"SELECT {NAMED} AS typology, 'account ' || b AS description, '7:' || src AS src, '0:' || dst AS dst, t, round(amount, 2) AS amount FROM good")
def _(spark, d):
    minutes = (F.unix_timestamp("ts") / 60).cast("long") - 28_401_120
    return N.rings(_patterns(spark, d)).select("typology", "description", "src", "dst", minutes.alias("t"), "amount")


@query("src_patterns_rings", ctes(EDGES, BLOCKS) + "SELECT count(DISTINCT b) AS n_rings, 0::BIGINT AS first, count(DISTINCT b) - 1 AS last FROM good")
def _(spark, d):
    return N.rings(_patterns(spark, d)).agg(F.count_distinct("ring").alias("n_rings"), F.min("ring").alias("first"), F.max("ring").alias("last"))


@query("hp_parse_anomalies", ctes(EDGES, BLOCKS) + """, an AS (SELECT 'malformed_row' AS kind, CAST(sum(bad) AS BIGINT) AS n FROM bl UNION ALL SELECT 'empty_block', count(*) FROM bl WHERE bad = n UNION ALL SELECT 'typology_mismatch', count(*) FROM bl WHERE b % 5 <> 0 AND b % 7 = 0 UNION ALL SELECT 'orphan_row', count(*) FROM bl WHERE b % 5 <> 0 AND b % 11 = 0
 UNION ALL SELECT 'left_open', count(*) FROM bl WHERE b % 5 = 0) SELECT * FROM an WHERE n > 0""")
def _(spark, d):
    kind = F.when(F.col("kind").isin("nested_begin", "unclosed_at_eof"), "left_open").otherwise(F.col("kind"))  # which of the two hangs on where a file ends
    return N.anomalies(_patterns(spark, d)).groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"))


@query("ag_patterns_describe", ctes(EDGES, BLOCKS) + f""", per AS (SELECT b, {NAMED} AS typology, count(DISTINCT a) AS accounts, any_value(n) AS edges FROM (SELECT b, unnest([src, dst]) AS a, count(*) OVER (PARTITION BY b) AS n FROM good) GROUP BY b)
 SELECT typology, count(*) AS n_rings, CAST(sum(edges) AS BIGINT) AS n_edges, min(accounts) AS accounts_min, list_sort(list(accounts))[len(list(accounts)) // 2 + 1] AS accounts_med, max(accounts) AS accounts_max, list_sort(list(edges))[len(list(edges)) // 2 + 1] AS edges_med, count(*) FILTER (accounts <= 2) AS trivial FROM per GROUP BY typology""")
def _(spark, d):
    return N.described(N.rings(_patterns(spark, d)))


STATIC = "nd AS (SELECT c_custkey AS node, c_nationkey AS cc FROM customer WHERE c_custkey % 10 = 0), owne AS (SELECT DISTINCT src, dst, coalesce(a.cc, b.cc) AS cc FROM edges LEFT JOIN nd a ON a.node = src LEFT JOIN nd b ON b.node = dst WHERE src % 10 = 0 OR dst % 10 = 0)"


def _static(spark: SparkSession, d: str) -> G.StaticGraph:
    def make() -> G.StaticGraph:
        path = _folder(spark, "static")
        c, e = spark.read.parquet(f"{d}/customer.parquet"), R.edges(spark, d)
        part = lambda df, name: df.write.option("header", True).csv(f"{path}/{name}.csv")
        part(c.select(F.col("c_nationkey").alias("ccId"), F.when(F.col("c_nationkey") % 3 == 0, " Licit").otherwise("suspicious").alias("ccLabel")).distinct(), "connected_components")
        part(c.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("clId"), F.col("c_nationkey").alias("ccId")), "nodes")
        part(e.filter("src % 10 = 0 or dst % 10 = 0").select(F.col("src").alias("clId1"), F.col("dst").alias("clId2")).distinct(), "edges")
        part(c.select(F.col("c_custkey").alias("clId")), "background_nodes")
        part(e.select("seq", F.col("src").alias("clId1"), F.col("dst").alias("clId2")), "background_edges")
        return G.load(spark, path)

    return once(spark, f"{d}/events.parquet", "static", make)


@query("src_static_edges", ctes(EDGES, STATIC) + "SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, count(*) AS n, sum(1.0::DOUBLE) AS amount FROM edges WHERE src IN (SELECT node FROM nd) OR dst IN (SELECT node FROM nd) GROUP BY 1, 2")
def _(spark, d):
    return _static(spark, d).edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("src_static_rings", ctes(EDGES, STATIC) + "SELECT CAST(cc AS VARCHAR) AS ring, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM owne WHERE cc % 3 <> 0")
def _(spark, d):
    return _static(spark, d).rings


@query("src_static_stats", ctes(EDGES, STATIC) + "SELECT (SELECT count(*) FROM customer) AS n_background_nodes, (SELECT count(*) FROM edges) AS n_scanned, n AS n_kept, n * 1.0::DOUBLE / (SELECT count(*) FROM edges) AS kept_share, (SELECT count(DISTINCT cc) FROM owne WHERE cc % 3 = 0) AS n_licit, (SELECT count(DISTINCT cc) FROM owne WHERE cc % 3 <> 0) AS n_suspicious FROM (SELECT count(*) AS n FROM edges WHERE src IN (SELECT node FROM nd) OR dst IN (SELECT node FROM nd))")
def _(spark, d):
    return _static(spark, d).stats
