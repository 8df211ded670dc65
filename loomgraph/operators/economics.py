"""Costs and benefits of a queue, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """Placeholder inputs in one currency; every figure is to be replaced by a sourced one."""

    minutes_per_case: float = 45.0
    cost_per_hour: float = 1500.0
    value_at_risk: float = 1_200_000.0
    recovery_rate: float = 0.35
    harm_per_false_positive: float = 20_000.0

    @property
    def review_cost(self) -> float:
        return self.minutes_per_case / 60 * self.cost_per_hour

    def break_even(self) -> float:
        return (self.review_cost + self.harm_per_false_positive) / (self.value_at_risk * self.recovery_rate + self.harm_per_false_positive)


def evaluate(rates: DataFrame, model: CostModel | None = None) -> DataFrame:
    """Per precision ``p``: net benefit of a case, and the value at risk from which reviewing pays."""
    m, p = model or CostModel(), F.col("p")
    net = p * m.value_at_risk * m.recovery_rate - (1 - p) * m.harm_per_false_positive - m.review_cost
    return rates.select("p", F.round(net, 4).alias("net"), F.round((m.review_cost + (1 - p) * m.harm_per_false_positive) / (p * m.recovery_rate), 2).alias("required_value"))


def sensitivity(spark: SparkSession, factors: tuple[float, ...] = (0.1, 0.5, 1.0, 2.0, 10.0), model: CostModel | None = None) -> DataFrame:
    """Break-even precision with one input at a time scaled; a rate scaled beyond one stays at one. As many rows as inputs and factors."""
    m, rows = model or CostModel(), []
    for name in (f.name for f in fields(m)):
        for k in factors:
            value = getattr(m, name) * k
            rows.append((name, k, round(replace(m, **{name: min(1.0, value) if name == "recovery_rate" else value}).break_even(), 6)))
    return spark.createDataFrame(rows, "input string, factor double, break_even double")


def best_k(rates: DataFrame, model: CostModel | None = None) -> DataFrame:
    """The queue length of the highest net benefit, null if none is positive. Rows are (k, p)."""
    m, p = model or CostModel(), F.col("p")
    net = F.col("k") * (p * m.value_at_risk * m.recovery_rate - (1 - p) * m.harm_per_false_positive - m.review_cost)
    t = rates.select("k", net.alias("net"))
    return t.agg(F.max_by(F.when(F.col("net") > 0, F.col("k")), "net").alias("k"), F.round(F.max("net"), 2).alias("net"))


def by_group(rows: DataFrame, model: CostModel | None = None, factors: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Costs per group out of its own figures (group, p, value): each input of the model scaled by each factor in turn.

    group, input, factor, break_even (the precision from which reviewing pays), net (of a case), required_value. ``value`` takes the place of the model's value at risk; a rate
    scaled beyond one stays at one.
    """
    m = model or CostModel()
    names = [f.name for f in fields(m)]
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("input"), F.lit(float(k)).alias("factor")) for n in names for k in factors]))
    x = rows.select("group", "p", "value", every.alias("_f")).select("group", "p", "value", "_f.*")
    of = {n: (F.col("value") if n == "value_at_risk" else F.lit(getattr(m, n))) * F.when(F.col("input") == n, F.col("factor")).otherwise(1.0) for n in names}
    rate = F.least(F.lit(1.0), of["recovery_rate"])
    review, harm, won = of["minutes_per_case"] / 60 * of["cost_per_hour"], of["harm_per_false_positive"], of["value_at_risk"] * rate
    p = F.col("p")
    return x.select("group", "input", "factor", ((review + harm) / (won + harm)).alias("break_even"), (p * won - (1 - p) * harm - review).alias("net"), F.when(p > 0, (review + (1 - p) * harm) / (p * rate)).alias("required_value"))


def best_k_by_group(ranked: DataFrame, ks: tuple[int, ...], value: float, model: CostModel | None = None) -> DataFrame:
    """Per group of ranked cases (group, rank, hit) the queue length of the highest net benefit, null if none is positive: group, k, net."""
    m = replace(model or CostModel(), value_at_risk=value)
    k = F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("rank") <= k))
    sums = ranked.select("group", "hit", k.alias("k")).groupBy("group", "k").agg(F.sum("hit").alias("h"), F.count("*").alias("n"))
    net = F.col("h") * m.value_at_risk * m.recovery_rate - (F.col("n") - F.col("h")) * m.harm_per_false_positive - F.col("n") * m.review_cost
    best = F.max(F.struct(net.alias("net"), (-F.col("k")).alias("_k")))
    g = sums.groupBy("group").agg(best.alias("b"))
    return g.select("group", F.when(F.col("b.net") > 0, -F.col("b._k")).alias("k"), F.col("b.net").alias("net"))
