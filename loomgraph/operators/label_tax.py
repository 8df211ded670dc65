"""What wrong and missing labels cost: all rates, seeds and controls as keys of one plan.

An arm is (rate, seed, kind). Labels are changed by a hash of the row and the seed, so an arm is the same wherever its rows lie, and a
larger rate changes all that a smaller one does. The ranker of these arms is the rate of positives per cell, smoothed, of which
all arms' are one aggregation; the true labels of the held-out cycles judge the first ``k`` of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.numbering import numbered
from loomgraph.operators.resample import _draw
from loomgraph.operators.stage import stage

ARM = ["rate", "seed", "kind"]


def _arms(rates: tuple[float, ...], seeds: int, kinds: tuple[str, ...]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(s).alias("seed"), F.lit(k).alias("kind")) for r in rates for s in range(seeds) for k in kinds]))


def _chosen(salt: int = 7) -> Column:
    return _draw(F.col("id"), F.col("seed"), salt) / 2147483647.0 < F.col("rate")


def relabelled(train: DataFrame, rates: tuple[float, ...], seeds: int = 3) -> DataFrame:
    """``train`` (id, cell, y) in every arm: was, and y, in which chosen positives are 0 (raw) or null, left out (control: as many positives fewer, none wrong)."""
    every = train.select("id", "cell", F.col("y").alias("was"), _arms(rates, seeds, ("raw", "control")).alias("a")).select("id", "cell", "was", "a.*")
    wrong = F.when(F.col("kind") == "raw", F.lit(0))
    return every.withColumn("y", F.when((F.col("was") == 1) & _chosen(), wrong).otherwise(F.col("was")))


def budgeted(train: DataFrame, shares: tuple[float, ...], seeds: int = 3) -> DataFrame:
    """``train`` in every arm with a share of its labels kept, the others null."""
    every = train.select("id", "cell", F.col("y").alias("was"), _arms(shares, seeds, ("budget",)).alias("a")).select("id", "cell", "was", "a.*")
    return every.withColumn("y", F.when(_chosen(), F.col("was")))


def arm_hits(arms: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """Per arm and held-out cycle of ``test`` (id, cycle, cell, y): true positives among the first ``k``, and how many those are. A cell of which an arm has no label takes the arm's rate.

    An arm gives all rows of a cell one score and ties go by id, so of a cycle's cell only the first ``k`` ids can be among the first ``k``; only those meet the arms.
    """
    rate = F.when(F.count("y") > 0, (F.sum("y") + 1.0) / (F.count("y") + 2.0)).alias("p")
    whole = arms.groupBy(*ARM).agg(rate)
    cell = arms.groupBy(*ARM, "cell").agg(rate)
    near = test.withColumn("_n", F.row_number().over(Window.partitionBy("cycle", "cell").orderBy("id"))).filter(F.col("_n") <= k).drop("_n")
    every = near.crossJoin(F.broadcast(whole.withColumnRenamed("p", "_all")))  # a row per arm
    scored = every.join(cell, [*ARM, "cell"], "left").withColumn("p", F.round(F.coalesce("p", "_all", F.lit(0.5)), 9))
    order = Window.partitionBy(*ARM, "cycle").orderBy(F.col("p").desc(), "id")
    return scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy(*ARM, "cycle").agg(F.sum("y").alias("hit"), F.count("*").alias("n"))


def slopes(hits: DataFrame, resamples: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Slope of p@k over the rate for each kind, and ``tax``, the raw slope less the control's, with intervals: kind, slope, low, high, n_units.

    Cycles are resampled, and one resample gives a p@k at every rate and kind, so slopes are paired.
    """
    per = hits.groupBy("rate", "kind", "cycle").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    units = stage(numbered(per.select("cycle").distinct(), ["cycle"], "i"))
    total = units.agg(F.count("*").alias("k"))
    draws = hits.sparkSession.range(resamples).withColumnRenamed("id", "r").crossJoin(F.broadcast(total)).filter("k > 0")  # one row
    drawn = draws.select("r", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j")).select("r", (_draw(F.col("r"), F.col("j"), seed) % F.col("k")).alias("i")).join(units, "i").select("r", "cycle")
    every = drawn.union(units.select(F.lit(-1).cast("long"), "cycle"))  # -1: all cycles once
    p = every.join(per, "cycle").groupBy("r", "kind", "rate").agg((F.sum("hit") / F.sum("n")).alias("p"))
    s = stage(p.groupBy("r", "kind").agg(F.regr_slope("p", "rate").alias("s")))
    tax = s.filter("kind = 'raw'").select("r", "s").join(s.filter("kind = 'control'").select("r", F.col("s").alias("c")), "r").select("r", F.lit("tax").alias("kind"), (F.col("s") - F.col("c")).alias("s"))
    v = F.sort_array(F.collect_list(F.when(F.col("r") >= 0, F.col("s"))))  # ``resamples`` numbers
    low, high = int((1 - level) / 2 * resamples + 1e-9), min(int((1 + level) / 2 * resamples + 1e-9), resamples - 1)
    return s.union(tax).groupBy("kind").agg(F.max(F.when(F.col("r") < 0, F.col("s"))).alias("slope"), v[low].alias("low"), v[high].alias("high")).crossJoin(F.broadcast(total.withColumnRenamed("k", "n_units")))


def required(hits: DataFrame) -> DataFrame:
    """How many cycles an effect needs to stand out of the spread between seeds, which shrinks with their root: kind, rate, spread, effect, n (null without an effect)."""
    per = hits.groupBy(*ARM).agg((F.sum("hit") / F.sum("n")).alias("p"))
    spread = per.groupBy("kind", "rate").agg((F.max("p") - F.min("p")).alias("spread"), F.avg("p").alias("p"))
    base = spread.filter("rate = 0").select("kind", F.col("p").alias("p0"))
    units = hits.agg(F.count_distinct("cycle").alias("k"))
    j = spread.filter("rate > 0").join(base, "kind").crossJoin(F.broadcast(units)).withColumn("effect", F.col("p") - F.col("p0"))  # one row
    ratio = F.col("spread") / F.abs("effect")
    return j.select("kind", "rate", "spread", "effect", F.when(F.abs("effect") > 1e-12, F.ceil(F.col("k") * ratio * ratio - 1e-9)).alias("n"))
