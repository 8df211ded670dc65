"""Several ways of seeding, pruning or suppressing, compared in one plan: the arm is a key, what the arms share is made once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import candidates as C
from loomgraph.operators import evaluate as E
from loomgraph.operators import resample
from loomgraph.operators.stage import stage


def seed_arms(arms: dict[str, DataFrame]) -> DataFrame:
    """Seeds (now, seed) of each arm as one table: arm, now, seed."""
    parts = [s.select(F.lit(name).alias("arm"), "now", "seed").distinct() for name, s in arms.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return stage(whole)


def arm_candidates(seeds: DataFrame, member: DataFrame) -> DataFrame:
    """Candidates of every arm: arm, now, key, seed, nodes, size. ``member`` (now, seed, node) holds the expansions of all arms' seeds, each made once; or has an
    arm of its own, where arms differ in what becomes of one expansion."""
    by = ["arm", "now", "seed"] if "arm" in member.columns else ["now", "seed"]
    sets = stage(member.groupBy(*by).agg(F.array_sort(F.collect_list("node")).alias("nodes")).filter(F.size("nodes") >= 3).withColumn("key", F.array_join(F.col("nodes").cast("array<string>"), ",")))
    j = sets if "arm" in by else seeds.join(sets, ["now", "seed"])
    return j.groupBy("arm", "now", "key").agg(F.min("seed").alias("seed"), F.first("nodes").alias("nodes")).withColumn("size", F.size("nodes"))


def arm_rows(cand: DataFrame, rings: DataFrame, ks: tuple[int, ...] = (5, 10), share: float = 0.5, jaccard: float = 0.3) -> DataFrame:
    """Per arm, cycle with rings and k: hits among the first k candidates by size, ties by key, and how many those are: arm, now, k, hit, n.

    A set that several arms have is held against the rings once. A cycle in which an arm has no candidate is a row of zeros.
    """
    sets = cand.select("now", "key", "nodes", "size").dropDuplicates(["now", "key"])
    good = stage(E.hits(sets, rings, share, jaccard).select("now", "key").distinct().withColumn("hit", F.lit(1)))
    order = Window.partitionBy("arm", "now").orderBy(F.col("size").desc(), "key")
    ranked = cand.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(ks)).join(good, ["now", "key"], "left")
    every = F.array(*[F.lit(k) for k in ks])
    found = ranked.select("arm", "now", "hit", F.explode(F.filter(every, lambda k: F.col("rank") <= k)).alias("k")).groupBy("arm", "now", "k").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"), F.count("*").alias("n"))
    cells = cand.select("arm").distinct().crossJoin(F.broadcast(rings.select("now").distinct())).select("arm", "now", F.explode(every).alias("k"))  # a row per cycle
    return cells.join(found, ["arm", "now", "k"], "left").na.fill(0, ["hit", "n"])


def merged(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Two arms of ``arm_rows`` side by side: now, k, hit_a, n_a, hit_b, n_b. Arms that don't share all cycles are refused, as their difference would be one of denominators; where one has no row at all there is nothing to set side by side."""
    side = lambda arm, s: rows.filter(F.col("arm") == arm).select("now", "k", F.col("hit").alias(f"hit_{s}"), F.col("n").alias(f"n_{s}"))
    j = stage(side(a, "a").join(side(b, "b"), ["now", "k"], "full_outer"))
    none_a, none_b = j.agg(F.count("n_a") == 0, F.count("n_b") == 0).first()
    if none_a or none_b:
        return j.filter("n_a is not null and n_b is not null")
    if lost := j.filter("n_a is null or n_b is null").select("now").distinct().limit(8).collect():
        raise ValueError(f"arms {a} and {b} don't share cycles {sorted(r.now for r in lost)}")
    return j


def precision(rows: DataFrame) -> DataFrame:
    """Ratio of sums over all cycles: arm, k, hits, n, p."""
    return rows.groupBy("arm", "k").agg(F.sum("hit").alias("hits"), F.sum("n").alias("n")).withColumn("p", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0))


def seeding_ratio(pairs: DataFrame, resamples: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """p@k of b over p@k of a, with an interval from resampling cycles, both arms together: k, ratio, low, high. Resamples in which a hits nothing have no ratio and are left out."""
    v = resample.unit_sums(pairs, "now", ["k"], ["hit_a", "n_a", "hit_b", "n_b"], resamples, seed)
    r = v.withColumn("v", F.when((F.col("hit_a") > 0) & (F.col("n_b") > 0), F.col("hit_b") / F.col("n_b") / (F.col("hit_a") / F.col("n_a"))))
    own = F.sort_array(F.collect_list(F.when(F.col("r") >= 0, F.col("v"))))  # a number per resample
    at = lambda q: F.least((F.size("_v") * q + 1e-9).cast("int"), F.size("_v") - 1)
    s = r.groupBy("k").agg(F.max(F.when(F.col("r") < 0, F.col("v"))).alias("ratio"), own.alias("_v"))
    return s.select("k", "ratio", F.get("_v", at((1 - level) / 2)).alias("low"), F.get("_v", at((1 + level) / 2)).alias("high"))


def cheat_cells(seeds: DataFrame, cand: DataFrame, rings: DataFrame, honest: str, cheat: str, share: float = 0.5, jaccard: float = 0.3) -> DataFrame:
    """Rings by whether each of two arms seeded and built them in any cycle: seeded_honest, seeded_cheat, built_honest, built_cheat, n_rings."""
    seeded = rings.select("now", "ring", F.col("node").alias("seed")).join(seeds, ["now", "seed"]).select("ring", "arm", F.lit("seeded").alias("stage"))
    sets = cand.select("now", "key", "nodes", "size").dropDuplicates(["now", "key"])
    built = E.hits(sets, rings, share, jaccard).join(cand.select("arm", "now", "key"), ["now", "key"]).select("ring", "arm", F.lit("built").alias("stage"))
    flag = lambda s, arm: F.coalesce(F.max((F.col("stage") == s) & (F.col("arm") == arm)), F.lit(False)).cast("int").alias(f"{s}_{'honest' if arm == honest else 'cheat'}")
    per = rings.select("ring").distinct().join(seeded.union(built), "ring", "left").groupBy("ring").agg(flag("seeded", honest), flag("seeded", cheat), flag("built", honest), flag("built", cheat))
    return per.groupBy("seeded_honest", "seeded_cheat", "built_honest", "built_cheat").agg(F.count("*").alias("n_rings"))


def suppress_totals(cand: DataFrame, by: str = "score", least: float = 0.5) -> DataFrame:
    """How many each order of suppression keeps, and how many went for those: arm, n_kept, n_absorbed. A row per order, without candidates too, where nothing was absorbed by no one (null)."""
    parts = [C.suppress(cand, least, by, order).agg(F.lit(order).alias("arm"), F.count("*").alias("n_kept"), F.sum("absorbed").alias("n_absorbed")) for order in C.ORDERS]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole
