"""What one task holds does not follow the size of the input."""

import random
from collections import defaultdict

from loomgraph import config
from loomgraph.operators import links as L
from loomgraph.operators import window as W


def _plain(pairs, max_width):
    into, out = defaultdict(set), defaultdict(set)
    for a, b in pairs:
        out[a].add(b), into[b].add(a)
    found = {}
    for n in set(into) | set(out):
        side, width = {"s": into[n], "r": out[n]}, len(into[n]) + len(out[n])
        s, r = len(into[n]), len(out[n])
        unclean = sum(len({x for x in side[a] if any((x, y) in pairs for y in side[b])}) / len(side[a]) for a in "sr" for b in "sr" if side[a])
        unclean += sum(len(into[n] & out[n]) / k for k in (s, r) if k)
        clean = max(0.0, 1 - unclean / (4 + (s > 0) + (r > 0))) * min(1.0, (min(s, r) if s and r else max(s, r) / 2) / config.SMURF_WIDTH)
        found[n] = (width, round(clean if width <= max_width else 0.0, 9))
    return found


def test_smurf_score_is_the_plain_one_without_expanded_rows(spark, capsys):
    r = random.Random(3)
    pairs = {tuple(r.sample(range(14), 2)) for _ in range(45)} | {(90, 91)}
    p = spark.createDataFrame([(60, a, b) for a, b in sorted(pairs)], "now long, src long, dst long")
    nodes = p.select("now", p.src.alias("node")).union(p.select("now", "dst")).distinct()
    got = L.smurf_score(nodes, p, max_width=7)
    assert {x.node: (x.width, round(x.smurf, 9)) for x in got.collect()} == _plain(pairs, 7)
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "Expand" not in plan  # distinct counts multiply no rows


def test_smurf_score_without_a_bound_scores_hubs_as_well(spark):
    r = random.Random(4)
    pairs = {tuple(r.sample(range(14), 2)) for _ in range(60)} | {(99, k) for k in range(100, 160)} | {(k, 99) for k in range(160, 175)} | {(100, 170), (170, 101), (101, 102)}
    p = spark.createDataFrame([(now, a, b) for a, b in sorted(pairs) for now in (60, 420)], "now long, src long, dst long")
    nodes = p.select("now", p.src.alias("node")).union(p.select("now", "dst")).filter("now = 60 or node % 3 = 0")
    plain = _plain(pairs, 10**9)
    got = {(x.now, x.node): (x.width, round(x.smurf, 9)) for x in L.smurf_score(nodes, p, max_width=None).collect()}
    assert got == {(now, n): v for n, v in plain.items() for now in (60, 420) if now == 60 or n % 3 == 0}
    assert got[60, 99][0] == 75 and got[60, 99][1] > 0.9


def test_a_hub_is_no_corner_that_pairs_are_made_at(spark):
    p = spark.createDataFrame([(60, 0, k) for k in range(1, 400)] + [(60, 1, 2)], "now long, src long, dst long")
    got = L.triads(p, spark.createDataFrame([(60, 0), (60, 1), (60, 2)], "now long, node long")).collect()
    assert {(x.node, x.src, x.s, x.r, x.to_s, x.to_r) for x in got} == {(0, 1, 0, 1, 0, 1), (1, 0, 1, 0, 0, 1), (2, 0, 1, 0, 1, 0)}


def test_a_long_window_is_dealt_by_the_number_of_edges(spark):
    e = spark.createDataFrame([(1, 1, 2, 5, 1.0), (2, 1, 2, 400, 2.0), (3, 2, 3, 9, 1.0)], "seq long, src long, dst long, t long, amount double")
    few, many = (W.islands(e, 4320, rows=n) for n in (3, 40 * W.HELD))
    assert many.rdd.getNumPartitions() == 40 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, W.islands(e, 4320).collect()))
