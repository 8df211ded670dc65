"""The full feature set of a candidate and its score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.functions import scalars as S
from loomgraph.operators import candidates as C
from loomgraph.operators import shapes as H
from loomgraph.operators import window as W
from loomgraph.operators.stage import stage

CENTRE = 360.0  # hours; times are taken from here on so that fourth powers keep their digits
SIDES = {"o": "amount", "i": "amount", "h": "hours"}


def _power_sums(kind: str, x: Column) -> list[Column]:
    return [F.count(x).alias(f"{kind}_n"), *[F.sum(F.pow(x, F.lit(float(k)))).alias(f"{kind}_s{k}") for k in (1, 2, 3, 4)], F.min(x).alias(f"{kind}_lo"), F.max(x).alias(f"{kind}_hi")]


def _moments(kind: str) -> dict[str, Column]:
    """Population moments out of power sums, with floors of sample size; no spread, no shape."""
    n, s1, s2, s3, s4 = (F.col(f"{kind}_{c}") for c in ("n", "s1", "s2", "s3", "s4"))
    m = s1 / n
    m2 = s2 / n - m * m
    flat = m2 <= 1e-9 * F.greatest(F.lit(1.0), m * m)
    m3 = s3 / n - 3 * m * s2 / n + 2 * F.pow(m, F.lit(3.0))
    m4 = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * F.pow(m, F.lit(4.0))
    z = F.lit(0.0)
    return {"mean": m, "std": F.when((n > 1) & ~flat, F.sqrt(m2)).otherwise(z), "skew": F.when((n >= 3) & ~flat, m3 / F.pow(m2, F.lit(1.5))).otherwise(z), "kurt": F.when((n >= 4) & ~flat, m4 / (m2 * m2) - 3).otherwise(z)}


def stats_as_of(edges: DataFrame, at: DataFrame) -> DataFrame:
    """Lifetime figures of accounts as known at each (now, node) of ``at``, never expired.

    Edges shrink to power sums per account and tick before they are put in order, so an account's history is no longer than
    the number of ticks; the running sums then meet the questions in one pass. Amounts are taken from the account's own mean on,
    so that powers of large amounts keep their digits.
    """
    hours = F.col("t") / 60.0 - CENTRE
    both = edges.select(F.col("src").alias("node"), "t", F.col("amount").alias("o"), F.lit(None).cast("double").alias("i")).union(edges.select("dst", "t", F.lit(None).cast("double"), "amount")).withColumn("h", hours)
    centre = stage(both.groupBy("node").agg(F.coalesce(F.avg("o"), F.lit(0.0)).alias("_o"), F.coalesce(F.avg("i"), F.lit(0.0)).alias("_i")))
    off = both.join(centre, "node")
    sums = [*_power_sums("o", F.col("o") - F.col("_o")), *_power_sums("i", F.col("i") - F.col("_i")), *_power_sums("h", F.col("h")), F.sum("o").alias("o_total"), F.sum("i").alias("i_total")]
    per = off.groupBy("node", S.tick_end(F.col("t")).alias("at")).agg(*sums, F.max(F.when(F.col("o").isNotNull(), F.col("t"))).alias("last_out"), F.min(F.when(F.col("i").isNotNull(), F.col("t"))).alias("first_in"))
    asked = at.select("node", F.col("now").alias("at"), F.col("now")).distinct()
    upto = Window.partitionBy("node").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    how = lambda c: F.min if c.endswith("_lo") or c == "first_in" else F.max if c.endswith("_hi") or c == "last_out" else F.sum
    every = per.withColumn("now", F.lit(None).cast("long")).unionByName(asked, allowMissingColumns=True)
    known = every.select("node", "now", *[how(c)(c).over(upto).alias(c) for c in per.columns if c not in ("node", "at")]).filter("now is not null")
    for kind in SIDES:
        known = known.select("*", *[v.alias(f"{kind}_{k}") for k, v in _moments(kind).items()])
    known = known.join(centre, "node")
    for kind in ("o", "i"):
        known = known.select(*[(F.col(c) + F.col(f"_{kind}")).alias(c) if c in (f"{kind}_mean", f"{kind}_lo", f"{kind}_hi") else F.col(c) for c in known.columns])
    through = (F.col("o_n") > 0) & (F.col("i_n") > 0)
    ratio = F.when(through & (F.col("i_total") > 0), F.least(F.lit(1.0), F.col("o_total") / F.col("i_total"))).otherwise(0.0)
    latency = F.when(through, (F.col("last_out") - F.col("first_in")) / 60.0)
    active = F.col("h_hi") - F.col("h_lo")
    return known.select("*", ratio.alias("value_ratio"), F.coalesce((ratio >= 0.8) & latency.between(0, 48), F.lit(False)).alias("fast"), (F.col("h_lo") + CENTRE).alias("dormancy"), F.when(active > 0, F.col("h_n") / active).otherwise(F.col("h_n").cast("double")).alias("velocity"))


def member_stats(member: DataFrame, edges: DataFrame) -> DataFrame:
    """Figures of a candidate's accounts taken together: now, seed, ..."""
    m = member.join(stats_as_of(edges, member.select("now", "node")), ["now", "node"])
    paid, got = F.col("o_n") > 0, F.col("i_n") > 0
    return m.groupBy("now", "seed").agg(
        F.avg(F.col("fast").cast("double")).alias("fast_passthrough_ratio"), F.median("value_ratio").alias("median_passthrough_value"), F.median("dormancy").alias("median_dormancy_h"), F.max(F.abs("o_skew")).alias("max_amount_skew"), F.avg("velocity").alias("mean_velocity"),
        F.avg(F.when(paid, F.col("o_mean"))).alias("mean_out_amount"), F.avg(F.when(paid, F.col("o_std"))).alias("mean_amount_std"), F.max(F.when(paid, F.abs("o_kurt"))).alias("max_amount_kurtosis"), F.avg(F.when(got, F.col("i_mean"))).alias("mean_in_amount"),
        F.min(F.least("o_lo", "i_lo")).alias("min_member_amount"), F.max(F.greatest("o_hi", "i_hi")).alias("max_member_amount"), F.avg("h_std").alias("mean_time_std_h"), F.avg("h_skew").alias("mean_time_skew"), F.max(F.abs("h_kurt")).alias("max_time_kurtosis"))


def registry_features(member: DataFrame, registry: DataFrame) -> DataFrame:
    """Banks, countries (an unknown one counts as one), entities and the dominant type, ties by name."""
    r = registry.select(F.col("key").alias("node"), "country", "bank", "entity_id", "entity_type")
    j = member.join(r, "node", "left")
    by_type = j.filter("entity_type is not null").groupBy("now", "seed", "entity_type").agg(F.count("*").alias("n"))
    top = by_type.groupBy("now", "seed").agg(F.min_by("entity_type", F.struct(-F.col("n"), F.col("entity_type"))).alias("dominant_entity_type"), (F.max("n") / F.sum("n")).alias("entity_type_purity"))
    g = j.groupBy("now", "seed").agg(F.count_distinct(F.coalesce("country", F.lit("Unknown"))).alias("n_countries"), F.count_distinct("bank").alias("n_banks"), F.count_distinct("entity_id").alias("n_entities"), F.count("entity_id").alias("n_known"))
    return g.join(top, ["now", "seed"], "left").withColumn("entity_reuse", F.when(F.col("n_entities") > 0, F.col("n_known") / F.col("n_entities")).otherwise(0.0)).drop("n_known")


def build(cand: DataFrame, member: DataFrame, inner: DataFrame, p: DataFrame, edges: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per candidate with at least two inner edges: now, key, seed, size and every feature; what a candidate lacks is zero."""
    cnt = F.col("cnt")
    own = inner.groupBy("now", "seed").agg(F.count("*").alias("n_edges"), F.sum("amount").alias("internal"), F.sum("cnt").alias("n_txns"), F.sum(F.when(S.is_round(F.round(F.col("amount") / cnt, 6)), cnt).otherwise(0)).alias("n_round"), (F.max("last_t") - F.min("first_t")).alias("span_minutes")).filter(F.col("n_edges") >= config.MIN_EDGES)
    sg6 = C.scatter_gather(inner, config.STRAND_MINUTES).withColumnRenamed("sg", "sg_6h")
    level = C.layers(inner)
    layers = level.select(*[S.rounded(c, 6).alias(c) if c in ("gargaml", "bipartite", "stack") else F.col(c) for c in level.columns])  # stored to six digits, so sums of many agree
    parts = (C.boundary_flow(member, inner, W.node_totals(p)), C.fans(inner), C.scatter_gather(inner), sg6, C.mutual(inner), H.shapes(inner), layers, member_stats(member, edges), registry_features(member, registry))
    j = reduce(lambda a, b: a.join(b, ["now", "seed"], "left"), parts, cand.select("now", "key", "seed", "size").join(own, ["now", "seed"]))
    j = j.na.fill(0).withColumn("exact", F.coalesce("exact", F.lit(True)))
    edge_flow = F.col("ext_in") + F.col("ext_out")
    share = lambda c: F.col(c) / F.col("size")
    return j.select("*", F.when(edge_flow > 0, F.col("internal") / edge_flow).otherwise(0.0).alias("churn"), (F.col("internal") + F.col("ext_in")).alias("total_amount"), (F.col("n_round") / F.col("n_txns")).alias("round_amount_ratio"), share("nodes_in_cycles").alias("cycle_coverage"), share("nodes_in_temporal").alias("temporal_cycle_coverage"), share("n_through").alias("passthrough_ratio"), F.greatest("max_out", "max_in").alias("max_fan"), F.when(F.col("gs") >= 2, F.col("gs")).otherwise(0).alias("gather_scatter"), (F.col("n_txns") / F.greatest(F.lit(1.0), F.col("span_minutes") / 60)).alias("burstiness"), (F.col("n_countries") > 1).alias("cross_border"))


def built(edges: DataFrame, registry: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Features of all cycles' candidates (``found``, or made here), staged, as several steps read them."""
    return stage(build(*(found or C.candidates(edges)), edges, registry))


def terms() -> dict[str, Column]:
    """The score's terms out of stored features, each from zero to one."""
    loop = lambda n, cover, short: F.when(F.col(n) > 0, 0.6 * F.col(cover) + 0.4 * F.col(short).between(1, 4).cast("int")).otherwise(0.0)
    return {
        "temporal_cycle": loop("n_temporal", "temporal_cycle_coverage", "shortest_temporal"),
        "conservation": F.col("conservation"),
        "fast_passthrough": F.col("fast_passthrough_ratio"),
        "scatter_gather": S.norm(F.col("sg"), 5),
        "gargaml": F.greatest(F.lit(0.0), F.col("gargaml")),
        "cycle": loop("n_cycles", "cycle_coverage", "shortest_cycle"),
        "gather_scatter": S.norm(F.col("gather_scatter"), 5),
        "bipartite": F.col("bipartite"),
        "stack": F.col("stack"),
        "passthrough": F.col("passthrough_ratio"),
        "cross_border": S.norm(F.greatest(F.lit(0), F.col("n_countries") - 1), 4),
        "burstiness": S.norm(F.col("burstiness"), 20),
        "round_amounts": F.col("round_amount_ratio"),
    }


def contributions() -> Column:
    """What each term adds to the score, as a map; retired terms add nothing."""
    weight = {k: 0.0 if k in config.RETIRED else w / config.SCALE for k, w in config.WEIGHTS.items()}
    return F.create_map(*[x for k, v in terms().items() for x in (F.lit(k), v.cast("double") * weight[k])])


def with_score(features: DataFrame) -> DataFrame:
    f = features.withColumn("contrib", contributions())
    return f.withColumn("score", F.round(F.aggregate(F.map_values("contrib"), F.lit(0.0), lambda a, b: a + b), 6))


def scored(edges: DataFrame, registry: DataFrame) -> DataFrame:
    return with_score(built(edges, registry))


def typology() -> Column:
    """The first reading that fits."""
    rules = ((F.col("n_temporal") > 0, "CYCLE"), (F.col("stack") >= 0.5, "STACK"), (F.col("bipartite") >= 0.5, "BIPARTITE"), (F.col("sg") >= 2, "SCATTER-GATHER"), (F.col("gather_scatter") >= 2, "GATHER-SCATTER"), (F.col("max_fan") >= 4, "FAN"))
    return reduce(lambda a, r: a.when(*r), rules[1:], F.when(*rules[0])).otherwise("CLUSTER")
