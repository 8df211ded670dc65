"""Intervals by resampling units with replacement, all resamples at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.numbering import numbered
from loomgraph.operators.stage import stage


def _draw(resample: Column, place: Column, seed: int) -> Column:
    """A pseudo-random number below 2^31 of a resample and a place in it."""
    x = (resample * 7919 + place * 104729 + seed) % 2147483647
    for _ in range(3):
        x = (x * 48271 + 11) % 2147483647
    return x


def paired_bootstrap(units: DataFrame, order: str, a: str, b: str, resamples: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Difference of the means of ``a`` and ``b`` over ``units`` and its percentile interval: diff, low, high, n.

    Units are drawn together with both values, so what they share cancels out. They are one row per cycle or day: a short
    table, numbered in one window. Drawing is by arithmetic on (resample, place), so each resample is made wherever its rows lie.
    """
    placed = units.select(F.col(order).alias("_o"), (F.col(a) - F.col(b)).cast("double").alias("d")).withColumn("i", F.row_number().over(Window.orderBy("_o")) - 1)
    total = placed.agg(F.count("*").alias("n"), F.avg("d").alias("diff"))
    spark = units.sparkSession
    draws = spark.range(resamples).withColumnRenamed("id", "r").crossJoin(F.broadcast(total))  # one row
    draws = draws.filter("n > 0").select("r", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j")).select("r", (_draw(F.col("r"), F.col("j"), seed) % F.col("n")).cast("int").alias("i"))
    means = draws.join(placed.select("i", "d"), "i").groupBy("r").agg(F.avg("d").alias("m"))
    ends = means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    return total.crossJoin(ends).select("diff", "low", "high", "n")  # one row each


def best_single_feature(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rank AUC of each feature alone, ties at their middle rank: feature, auc. Rows are summed up per value before they are ranked."""
    long = rows.select(F.col(label).cast("long").alias("y"), F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "v"))
    per = long.groupBy("feature", "v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("feature").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("w", F.col("p") * (below + F.col("q") / 2)).groupBy("feature").agg((F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auc"))


def _cluster_ratios(rows: DataFrame, cluster: str, hits: str, n: str, resamples: int, seed: int) -> DataFrame:
    """Ratio of sums in each resample of whole clusters: r, v. A cluster is summed up once, and numbered in order of its key."""
    sums = rows.groupBy(F.col(cluster).alias("_c")).agg(F.sum(hits).alias("h"), F.sum(n).alias("m"))
    keys = stage(numbered(sums, ["_c"], "i"))
    total = keys.agg(F.count("*").alias("k"))
    draws = rows.sparkSession.range(resamples).withColumnRenamed("id", "r").crossJoin(F.broadcast(total)).filter("k > 0")  # one row
    drawn = draws.select("r", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j")).select("r", (_draw(F.col("r"), F.col("j"), seed) % F.col("k")).alias("i"))
    return drawn.join(keys.select("i", "h", "m"), "i").groupBy("r").agg(F.when(F.sum("m") > 0, F.sum("h") / F.sum("m")).otherwise(0.0).alias("v"))


def cluster_bootstrap(rows: DataFrame, clusters: list[str], hits: str, n: str, resamples: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Ratio of the sums of ``hits`` and ``n`` with its percentile interval under each clustering, and the widest of them as ``all``: clustering, point, low, high, n_clusters.

    Whole clusters are drawn with replacement, by the same arithmetic for every clustering. The ends are the values at the places
    floor(a N) of the N sorted resamples.
    """
    point = rows.agg((F.sum(hits) / F.sum(n)).alias("point"))
    found = None
    for c in clusters:
        v = F.sort_array(F.collect_list("v"))  # ``resamples`` numbers
        low, high = int((1 - level) / 2 * resamples + 1e-9), min(int((1 + level) / 2 * resamples + 1e-9), resamples - 1)
        ends = _cluster_ratios(rows, c, hits, n, resamples, seed).agg(v[low].alias("low"), v[high].alias("high"))
        one = ends.crossJoin(rows.agg(F.count_distinct(c).alias("n_clusters"))).select(F.lit(c).alias("clustering"), "low", "high", "n_clusters")  # one row each
        found = one if found is None else found.union(one)
    found = stage(found)
    whole = found.unionByName(found.agg(F.lit("all").alias("clustering"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("n_clusters").alias("n_clusters")))
    return whole.crossJoin(F.broadcast(point)).select("clustering", "point", "low", "high", "n_clusters")


def unit_sums(rows: DataFrame, unit: str, by: list[str], columns: list[str], resamples: int = 2000, seed: int = 7) -> DataFrame:
    """Sums of ``columns`` per group of ``by`` over each resample of whole units, drawn with replacement: r, by, columns. r = -1 has every unit once."""
    per = rows.groupBy(F.col(unit).alias("_u"), *by).agg(*[F.sum(c).alias(c) for c in columns])
    units = stage(numbered(per.select("_u").distinct(), ["_u"], "i"))
    total = units.agg(F.count("*").alias("k"))
    draws = rows.sparkSession.range(resamples).withColumnRenamed("id", "r").crossJoin(F.broadcast(total)).filter("k > 0")  # one row
    drawn = draws.select("r", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j")).select("r", (_draw(F.col("r"), F.col("j"), seed) % F.col("k")).alias("i")).join(units, "i").select("r", "_u")
    every = drawn.union(units.select(F.lit(-1).cast("long"), "_u"))
    return every.join(per, "_u").groupBy("r", *by).agg(*[F.sum(c).alias(c) for c in columns])
