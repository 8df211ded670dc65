"""The sliding window as tables keyed by (now, ...): live edges, pairs, neighbours, totals, lifetime statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions.scalars import tick_end


def live(edges: DataFrame, width: int = config.WINDOW, tick: int = config.TICK, step: int = config.STEP, horizon: int = config.HORIZON) -> DataFrame:
    """Each edge once per cycle it is live in: tick_end <= now < tick_end + width. An edge names its own cycles, so no range join is needed.

    The numbers of an edge's cycles come from a table of a few rows and not from an array: Spark takes exploded rows to be no more than the rows they come
    from, and would send pairs that are many times a small file to the driver to broadcast them.
    """
    end = tick_end(F.col("t"), tick)
    first = F.ceil((end - tick) / step) * step + tick
    turn = edges.sparkSession.range(0, -(-width // step), 1, 1).toDF("_turn")
    each = edges.crossJoin(F.broadcast(turn)).withColumn("now", first + F.col("_turn") * step).drop("_turn")  # a row per step of the width
    return each.filter((F.col("now") < end + width) & (F.col("now") >= width / 2) & (F.col("now") <= horizon))


#: Edges that one task holds before a long window makes a row per cycle of each.
HELD = 50_000


def islands(edges: DataFrame, width: int = config.WINDOW, tick: int = config.TICK, rows: int | None = None) -> DataFrame:
    """``edges`` with island_first: the first edge since their pair was last out of the window.

    With ``rows``, about how many edges there are, they are dealt to as many tasks as keep each at ``HELD``, so that what follows in
    the same task, a row per cycle, does not grow with the input.
    """
    if rows is not None:
        edges = edges.repartition(max(1, -(-rows // HELD), edges.sparkSession.sparkContext.defaultParallelism), "src", "dst")
    own = Window.partitionBy("src", "dst").orderBy("t", "seq")
    end = tick_end(F.col("t"), tick)
    gap = -(-width // tick) * tick
    fresh = (end - F.lag(end).over(own) > gap).cast("int")
    e = edges.withColumn("_i", F.sum(F.coalesce(fresh, F.lit(1))).over(own))
    return e.withColumn("island_first", F.min("t").over(Window.partitionBy("src", "dst", "_i"))).drop("_i")


def pairs(live_edges: DataFrame) -> DataFrame:
    """Per (now, src, dst): cnt, amount, first_t, last_t. Needs the rows of ``live(islands(edges))``."""
    return live_edges.groupBy("now", "src", "dst").agg(F.count("*").alias("cnt"), F.sum("amount").alias("amount"), F.min("island_first").alias("first_t"), F.max("t").alias("last_t"))


def neighbours(p: DataFrame) -> DataFrame:
    """Both directions of each pair, once: now, node, other."""
    return p.select("now", F.col("src").alias("node"), F.col("dst").alias("other")).union(p.select("now", "dst", "src")).distinct()


def node_totals(p: DataFrame) -> DataFrame:
    """Per (now, node): total_out, total_in, n_out, n_in."""
    both = p.select("now", F.col("src").alias("node"), F.col("amount").alias("o"), F.lit(None).cast("double").alias("i")).union(p.select("now", "dst", F.lit(None).cast("double"), "amount"))
    return both.groupBy("now", "node").agg(F.coalesce(F.sum("o"), F.lit(0.0)).alias("total_out"), F.coalesce(F.sum("i"), F.lit(0.0)).alias("total_in"), F.count("o").alias("n_out"), F.count("i").alias("n_in"))


def accounts_of_window(edges: DataFrame) -> DataFrame:
    """Per cycle: edges ever added, expired and live, so that the first is the sum of the others.

    Counts per tick are summed up over time before any cycle sees them; there are no more rows than ticks.
    """
    now = live(edges).groupBy("now").agg(F.count("*").alias("n_live"))
    ticks = edges.groupBy(tick_end(F.col("t")).alias("now")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("now").rangeBetween(Window.unboundedPreceding, 0))
    every = ticks.join(now, "now", "full_outer").select("now", F.coalesce("n", F.lit(0)).alias("n"), "n_live").withColumn("added", run)
    return every.filter("n_live is not null").select("now", "added", (F.col("added") - F.col("n_live")).alias("expired"), "n_live")


def moments(x: Column, prefix: str) -> list[Column]:
    """Population moments with floors: variance from two, skewness from three, kurtosis from four values, zero without spread."""
    n = F.count(x)
    return [n.alias(f"{prefix}_n"), F.avg(x).alias(f"{prefix}_mean"), F.when(n > 1, F.var_pop(x)).otherwise(0.0).alias(f"{prefix}_var"), F.when(n >= 3, F.coalesce(F.skewness(x), F.lit(0.0))).otherwise(0.0).alias(f"{prefix}_skew"), F.when(n >= 4, F.coalesce(F.kurtosis(x), F.lit(0.0))).otherwise(0.0).alias(f"{prefix}_kurt"), F.sum(x).alias(f"{prefix}_total"), F.min(x).alias(f"{prefix}_min"), F.max(x).alias(f"{prefix}_max")]


def account_stats(edges: DataFrame) -> DataFrame:
    """Lifetime per node, never expired: flows, pass-through, latency, activity."""
    both = edges.select(F.col("src").alias("node"), "t", F.col("amount").alias("o"), F.lit(None).cast("double").alias("i")).union(edges.select("dst", "t", F.lit(None).cast("double"), "amount"))
    out, into = F.col("out_total"), F.col("in_total")
    g = both.groupBy("node").agg(F.count("o").alias("n_out"), F.count("i").alias("n_in"), F.sum("o").alias("out_total"), F.sum("i").alias("in_total"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max(F.when(F.col("o").isNotNull(), F.col("t"))).alias("last_out"), F.min(F.when(F.col("i").isNotNull(), F.col("t"))).alias("first_in"), F.count("*").alias("n"))
    through = (F.col("n_out") > 0) & (F.col("n_in") > 0)
    latency = F.when(through, (F.col("last_out") - F.col("first_in")) / 60.0)
    ratio = F.when(through & (into > 0), F.least(F.lit(1.0), out / into)).otherwise(0.0)
    return g.select("node", "n", "n_out", "n_in", through.alias("passthrough"), ratio.alias("value_ratio"), latency.alias("latency_h"), F.coalesce((ratio >= 0.8) & latency.between(0, 48), F.lit(False)).alias("fast_passthrough"), (F.col("first_t") / 60.0).alias("dormancy_h"), ((F.col("last_t") - F.col("first_t")) / 60.0).alias("active_h"))


def induced_by(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with both ends among ``nodes`` (one column)."""
    own = nodes.toDF("_node").distinct()
    first = edges.join(own, edges["src"] == own["_node"], "left_semi")
    return first.join(own, first["dst"] == own["_node"], "left_semi")
