"""Counterparties around one account, and candidates joined by what lies between them."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.operators import window as W
from loomgraph.operators.stage import stage


def triads(p: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every payment between two counterparties of one of ``nodes`` (now, node): now, node, src, and as 0 or 1 whether src pays the node (s) or is paid by it (r), and likewise the one that src pays (to_s, to_r).

    A triangle of accounts is found once, from the corner of the lowest degree, ties by number, so a hub's counterparties are never paired: with m
    linked pairs in a cycle no account has more than sqrt(2 m) neighbours above it.
    """
    link = p.select("now", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).cast("int").alias("ab"), (F.col("src") > F.col("dst")).cast("int").alias("ba"))
    link = stage(link.groupBy("now", "a", "b").agg(F.max("ab").alias("ab"), F.max("ba").alias("ba")))
    degree = link.select("now", F.col("a").alias("node")).union(link.select("now", "b")).groupBy("now", "node").agg(F.count("*").alias("deg"))
    degree = stage(degree.join(nodes.select("now", "node").withColumn("_in", F.lit(True)), ["now", "node"], "left").select("now", "node", F.struct("deg", "node").alias("at"), F.coalesce("_in", F.lit(False)).alias("own")))
    end = lambda n: degree.select("now", F.col("node").alias(n), F.col("at").alias(f"at_{n}"), F.col("own").alias(f"own_{n}"))
    both = link.join(end("a"), ["now", "a"]).join(end("b"), ["now", "b"])
    up = F.col("at_a") < F.col("at_b")
    pick = lambda a, b, name: F.when(up, F.col(a)).otherwise(F.col(b)).alias(name)
    e = stage(both.select("now", pick("a", "b", "x"), pick("b", "a", "y"), pick("ab", "ba", "xy"), pick("ba", "ab", "yx"), pick("at_b", "at_a", "at_y"), pick("own_a", "own_b", "own_x"), pick("own_b", "own_a", "own_y")))
    z = e.select("now", "x", F.col("y").alias("z"), F.col("xy").alias("xz"), F.col("yx").alias("zx"), F.col("at_y").alias("at_z"), F.col("own_y").alias("own_z"))
    open_ = e.join(z, ["now", "x"]).filter((F.col("at_y") < F.col("at_z")) & (F.col("own_x") | F.col("own_y") | F.col("own_z"))).drop("at_y", "at_z")
    t = open_.join(e.select("now", F.col("x").alias("y"), F.col("y").alias("z"), F.col("xy").alias("yz"), F.col("yx").alias("zy")), ["now", "y", "z"])
    turn = lambda n, u, v: F.struct(F.col(n).alias("node"), F.col(u).alias("src"), (F.col(f"own_{n}") & (F.col(u + v) == 1)).alias("pays"), *[F.col(c).alias(k) for k, c in (("s", u + n), ("r", n + u), ("to_s", v + n), ("to_r", n + v))])
    return t.select("now", F.inline(F.array(*[turn(*o) for o in permutations("xyz")]))).filter("pays").drop("pays")


def smurf_score(nodes: DataFrame, p: DataFrame, max_width: int | None = config.MAX_DEGREE) -> DataFrame:
    """Per (now, node) of ``nodes``: width, and how cleanly its senders and receivers keep apart, times how wide it is.

    Unclean: a sender or receiver that pays another of them, or is both. With ``max_width`` nodes of more counterparties score zero.
    """
    nodes = stage(nodes.select("now", "node").distinct())
    into = p.join(nodes.withColumnRenamed("node", "dst"), ["now", "dst"], "left_semi").select("now", F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(1).alias("s"), F.lit(0).alias("r"))
    out = p.join(nodes.withColumnRenamed("node", "src"), ["now", "src"], "left_semi").select("now", F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("s"), F.lit(1).alias("r"))
    others = into.union(out).groupBy("now", "node", "other").agg(F.max("s").alias("s"), F.max("r").alias("r"))  # a row a counterparty, on one side or both
    size = stage(others.groupBy("now", "node").agg(F.sum("s").alias("n_s"), F.sum("r").alias("n_r"), F.sum(F.col("s") * F.col("r")).alias("n_both")))
    s, r = F.col("n_s"), F.col("n_r")
    wide = F.lit(False) if max_width is None else s + r > max_width
    near = size.filter((s + r >= 2) & ~wide).select("now", "node")
    pays = triads(p, near).groupBy("now", "node", "src").agg(*[F.max(c).alias(c) for c in ("s", "r", "to_s", "to_r")])
    part = pays.groupBy("now", "node").agg(*[F.sum(F.col(a) * F.col(f"to_{b}")).alias(f"e_{a}{b}") for a in "sr" for b in "sr"])
    j = size.join(part, ["now", "node"], "left").fillna(0)
    share = lambda c, d: F.when(d > 0, c / d).otherwise(0.0)
    unclean = reduce(lambda a, b: a + b, [share(F.col(f"e_{a}{b}"), F.col(f"n_{a}")) for a in "sr" for b in "sr"]) + share(F.col("n_both"), s) + share(F.col("n_both"), r)
    kinds = 4 + (s > 0).cast("int") + (r > 0).cast("int")
    width = F.when((s > 0) & (r > 0), F.least(s, r)).otherwise(F.greatest(s, r) / 2)
    clean = F.greatest(F.lit(0.0), 1 - unclean / kinds) * F.least(F.lit(1.0), width / config.SMURF_WIDTH)
    return j.select("now", "node", (s + r).alias("width"), F.when(wide, 0.0).otherwise(clean).alias("smurf"))


def bridges(cand: DataFrame, p: DataFrame, pool: int = config.LINK_POOL, degree: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of a cycle's first ``pool`` candidates (by size, then key) with a small bridge between them: now, key_a, key_b, bridge, merged.

    The bridge's accounts are paid by the first and pay the second, belong to neither, are no hubs, and one of them
    at least can have passed value on in time. The merge leaves the bridge out. With ``degree`` (now, node, deg), ``p`` need only
    hold the pairs of the candidates' accounts.
    """
    order = Window.partitionBy("now").orderBy(F.col("size").desc(), "key")
    first = cand.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= pool)
    m = first.select("now", "key", F.explode("nodes").alias("node"))
    degree = W.neighbours(p).groupBy("now", "node").agg(F.count("*").alias("deg")) if degree is None else degree
    small = degree.filter(F.col("deg") <= config.MAX_DEGREE).select("now", F.col("node").alias("x"))
    own = m.select("now", "key", F.col("node").alias("x"))
    outside = lambda e: e.join(own, ["now", "key", "x"], "left_anti").join(small, ["now", "x"], "left_semi")
    out = outside(m.withColumnRenamed("node", "src").join(p, ["now", "src"]).groupBy("now", "key", F.col("dst").alias("x")).agg(F.min("first_t").alias("t_in")))
    into = outside(m.withColumnRenamed("node", "dst").join(p, ["now", "dst"]).groupBy("now", "key", F.col("src").alias("x")).agg(F.max("last_t").alias("t_out")))
    rare = lambda d: d.withColumn("fan", F.count("*").over(Window.partitionBy("now", "x"))).filter(F.col("fan") <= config.MAX_WITNESS).drop("fan")
    w = rare(out).withColumnRenamed("key", "key_a").join(rare(into).withColumnRenamed("key", "key_b"), ["now", "x"]).filter("key_a <> key_b")
    g = w.groupBy("now", "key_a", "key_b").agg(F.array_sort(F.collect_list("x")).alias("bridge"), F.max(F.col("t_out") >= F.col("t_in")).alias("ordered")).filter(F.col("ordered") & (F.size("bridge") <= config.MAX_BRIDGE))
    a, b = first.select("now", F.col("key").alias("key_a"), F.col("nodes").alias("a")), first.select("now", F.col("key").alias("key_b"), F.col("nodes").alias("b"))
    j = g.join(a, ["now", "key_a"]).join(b, ["now", "key_b"]).withColumn("merged", F.array_sort(F.array_union("a", "b")))
    n = F.size("merged")
    return j.filter((n > F.size("a")) & (n > F.size("b")) & (n <= config.MAX_MERGED)).select("now", "key_a", "key_b", "bridge", "merged")
