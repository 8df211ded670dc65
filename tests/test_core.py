"""Window, expansion, motifs and metrics on small graphs, and the entry's contract."""

import pytest

from loomgraph.functions import scalars as S
from loomgraph.operators import candidates as C
from loomgraph.operators import features as X
from loomgraph.operators import shapes as H
from loomgraph.operators import economics
from loomgraph.operators import evaluate as E
from loomgraph.operators import window as W
from loomgraph.sources import readers


def edges(spark, rows):
    return spark.createDataFrame([(i, s, d, t, float(a)) for i, (t, s, d, a) in enumerate(rows)], "seq long, src long, dst long, t long, amount double")


def pairs(spark, rows, **kw):
    return W.pairs(W.live(W.islands(edges(spark, rows), kw.get("width", 360)), **kw))


def inner(spark, pairs_):
    return spark.createDataFrame([(1, 0, a, b, 1, 10.0, t, t) for a, b, t in pairs_], "now long, seed long, src long, dst long, cnt long, amount double, first_t long, last_t long")


def test_repeat_pair_and_expiry(spark):
    got = {(r.now, r.src, r.dst): r for r in pairs(spark, [(1, 10, 20, 100), (5, 10, 20, 50), (70, 10, 20, 40)], width=120, tick=60, step=60, horizon=600).collect()}
    assert got[60, 10, 20].cnt == 2 and got[60, 10, 20].amount == 150 and (got[60, 10, 20].first_t, got[60, 10, 20].last_t) == (1, 5)
    assert got[120, 10, 20].cnt == 3 and got[180, 10, 20].cnt == 1 and got[180, 10, 20].amount == 40 and got[180, 10, 20].first_t == 1
    assert (240, 10, 20) not in got


def test_expansion_stops_at_hubs(spark):
    n = W.neighbours(inner(spark, [(0, 1, 0), (1, 2, 0), (2, 3, 0), *[(1, 100 + i, 0) for i in range(60)]]))
    seed = spark.createDataFrame([(1, 0), (1, 1)], "now long, seed long")
    got = {}
    for r in C.expand(seed, n).collect():
        got.setdefault(r.seed, set()).add(r.node)
    assert got == {0: {0, 1}, 1: {1}}
    capped = C.expand(spark.createDataFrame([(1, 3)], "now long, seed long"), n, max_nodes=2).collect()
    assert {r.node for r in capped} == {3, 2}


def test_motifs(spark):
    sg = inner(spark, [(0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 9, 0), (2, 9, 0), (3, 9, 0)])
    assert C.scatter_gather(sg).first().sg == 3
    assert C.scatter_gather(inner(spark, [(0, 1, 0), (1, 9, 0)])).count() == 0
    fan = C.fans(inner(spark, [(0, k, 0) for k in range(1, 6)])).first()
    assert (fan.max_out, fan.max_in, fan.n_nodes) == (5, 1, 6)
    t = C.triangles(inner(spark, [(0, 1, 10), (1, 2, 20), (2, 0, 30)])).first()
    assert (t.n_cycles3, t.n_temporal3) == (1, 1)
    assert C.triangles(inner(spark, [(0, 1, 30), (1, 2, 20), (2, 0, 10)])).first().n_temporal3 == 0


def test_suppression_is_greedy(spark):
    rows = [(1, "1,2,3", [1, 2, 3], 3.0), (1, "1,2,3,4", [1, 2, 3, 4], 2.0), (1, "7,8,9", [7, 8, 9], 1.0)]
    got = {r.key: r.absorbed for r in C.suppress(spark.createDataFrame(rows, "now long, key string, nodes array<long>, score double")).collect()}
    assert got == {"1,2,3": 1, "7,8,9": 0}


def test_scalars(spark):
    from pyspark.sql import functions as F

    rows = [("016871", "2848.960"), ("000", "0.005"), ("  ", "100.0"), ("16871", "2848.96")]
    df = spark.createDataFrame(rows, "b string, a string")
    got = [tuple(r) for r in df.select(S.account_key(F.col("b"), F.lit("X")), S.amount_key(F.col("a"))).collect()]
    assert got == [("16871:X", "2848.96"), ("0:X", "0.005"), ("?:X", "100"), ("16871:X", "2848.96")]
    names = spark.createDataFrame([("UK Bank #12",), ("Savings Bank #12",), ("Crytpo Bank #1",), (None,)], "n string")
    assert [r[0] for r in names.select(S.country(F.col("n"))).collect()] == ["UK", "USA", "Crypto", "USA"]


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.340,US Dollar,3697.34,US Dollar,Reinvestment,0\n2022/09/01 00:06,021174,800737690,012,80011F990,2848.96,Euro,2848.96,Euro,ACH,1\n")
    got = readers.transactions(spark, str(tmp_path / "t.csv")).orderBy("ts").collect()
    assert [(r.src, r.dst, r.amount_key, r.label) for r in got] == [("21174:800737690", "12:80011F990", "2848.96", 1), ("10:8000EBD30", "10:8000EBD30", "3697.34", 0)]
    (tmp_path / "p.txt").write_text("BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 16-degree Fan-Out\n2022/09/01 00:06,021174,800737690,012,80011F990,2848.96,Euro,2848.96,Euro,ACH,1\nEND LAUNDERING ATTEMPT - FAN-OUT\n\nstray\n")
    rings = readers.patterns(spark, str(tmp_path / "p.txt"))
    assert [(r.ring, r.typology, r.src) for r in rings.collect()] == [(0, "FAN-OUT", "21174:800737690")]
    labelled = readers.label_edges(readers.transactions(spark, str(tmp_path / "t.csv")), rings).orderBy("ts").collect()
    assert [r.ring for r in labelled] == [0, -1]


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    assert E.rank_auc(df, "s", "y").first().auc == 0.875
    assert E.expected_precision(df, "s", "y", 2).first().p == 0.75
    point, low, high = E.bootstrap([{"h": k % 2, "n": 1} for k in range(40)], lambda r: sum(x["h"] for x in r) / sum(x["n"] for x in r))
    assert point == 0.5 and low < 0.5 < high
    assert economics.CostModel().break_even() == pytest.approx((1125 + 20000) / (420000 + 20000))


def test_labels_never_reach_the_score(spark):
    from pyspark.sql import functions as F

    e = readers.edges(spark, "/root/testdata/sf0.001")
    r = readers.registry(spark, "/root/testdata/sf0.001")
    score = lambda x: sorted(map(tuple, X.scored(x, r).select("now", "key", "size", "score").collect()))
    a = score(e)
    assert a and a == score(e.withColumn("label", 1 - F.col("label")))


def test_cycles_are_simple_and_from_the_smallest_node():
    ring = [(k, (k + 1) % 5, k, k) for k in range(5)]
    assert H.cycles(ring) == [(0, 1, 2, 3, 4)]
    assert H.cycles([(0, 1, 0, 0), (1, 0, 0, 0)]) == []
    assert H.cycles([(k, (k + 1) % 12, 0, 0) for k in range(12)]) == []
    full = [(a, b, 0, 0) for a in range(6) for b in range(6) if a != b]
    assert len(H.cycles(full, limit=10**6)) == 40 + 90 + 144 + 120
    assert [len(c) for c in H.cycles(full)] == sorted(len(c) for c in H.cycles(full)) and len(H.cycles(full)) == 200


def test_a_cycle_is_travelled_in_time_order():
    assert H.travelled((0, 1, 2), {(0, 1): (10, 10), (1, 2): (20, 20), (2, 0): (30, 30)})
    assert H.travelled((0, 1, 2), {(0, 1): (20, 20), (1, 2): (30, 30), (2, 0): (10, 10)})
    assert not H.travelled((0, 1, 2), {(0, 1): (30, 30), (1, 2): (20, 20), (2, 0): (10, 10)})


def test_iterated_prunings():
    near = {0: {1, 2}, 1: {0, 2, 3}, 2: {0, 1}, 3: {1, 4}, 4: {3}}
    assert H.core2(set(range(5)), 0, near) == {0, 1, 2}
    assert H.core2(set(range(5)), 4, near) == {0, 1, 2, 3, 4}
    assert H.near_or_linked(set(range(5)), 0, near) == {0, 1, 2}


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("parts", [1, 16])
def test_numbers_are_gapless_in_order_whatever_the_partitions(spark, parts):
    from loomgraph.operators.numbering import numbered

    rows = [(None if i % 50 == 0 else (7 if i % 3 else i * 37 % 101), i % 5) for i in range(900)]  # one key holds two thirds
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(parts), ["a", "b"], "n", 1).collect()
    assert sorted(r.n for r in got) == list(range(1, 901))
    in_order = [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)]
    assert in_order == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert numbered(spark.createDataFrame([], "a long, b long"), ["a"], "n").count() == 0


@pytest.mark.parametrize("order", C.ORDERS)
def test_suppression_in_rounds_equals_the_greedy_walk(spark, order):
    import random

    r, rows = random.Random(order), []
    for now in range(12):
        pool = [r.sample(range(14), r.randint(3, 8)) for _ in range(r.randint(1, 25))]
        rows += [(now, ",".join(map(str, sorted(n))), sorted(n), float(r.randint(0, 4)), i) for i, n in enumerate({tuple(sorted(n)): n for n in pool}.values())]
    rows += [(50, f"{i:03}", [i, i + 1, i + 2], -float(i), i) for i in range(14)]  # a long chain: each round settles a link
    rank = {"score": lambda x: (-x[3], x[1]), "largest": lambda x: (-len(x[2]), x[1]), "smallest": lambda x: (len(x[2]), x[1]), "key": lambda x: x[1]}[order]
    expected = {}
    for now in {x[0] for x in rows}:
        kept = []
        for x in sorted((x for x in rows if x[0] == now), key=rank):
            hit = next((k for k in kept if 2 * len(set(k[2]) & set(x[2])) >= len(set(k[2]) | set(x[2]))), None)
            if hit is None:
                kept.append(x)
            key = (now, (hit or x)[1])
            expected[key] = expected.get(key, -1) + 1
    cand = spark.createDataFrame(rows, "now long, key string, nodes array<long>, score double, seed long")
    got = {(x.now, x.key): x.absorbed for x in C.suppress(cand, order=order).collect()}
    assert got == expected
    assert C.absorptions(cand, order=order).count() == sum(expected.values())


def test_an_unknown_order_is_refused(spark):
    with pytest.raises(ValueError, match="unknown order"):
        C.suppress(spark.createDataFrame([], "now long, key string, nodes array<long>, score double"), order="whatever")


def plain_trace(links, seed, hops, degree, cap):
    """One expansion, walked node by node."""
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    deg = lambda n: len(near.get(n, ()))
    seen, front, done, blocked, cut, out, full = {seed}, {seed}, 0, 0, False, False, False
    for _ in range(hops):
        blocked += sum(deg(n) > degree for n in front)
        found = set().union(*[near.get(n, set()) for n in front if deg(n) <= degree]) - seen
        if not found:
            out = True
            break
        if len(seen) >= cap:
            full = True
            break
        front = set(sorted(found, key=lambda n: (deg(n), n))[: cap - len(seen)])
        cut |= len(front) < len(found)
        seen |= front
        done += 1
    return sorted(seen), done, blocked, cut, out, full


@pytest.mark.parametrize("hops, degree, cap", [(2, 3, 200), (3, 50, 6), (4, 5, 9), (2, 50, 1)])
def test_traced_expansion_equals_a_walk(spark, hops, degree, cap):
    import random

    r = random.Random(hops)
    links = {(a, b) for a, b in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(60)) if a != b}
    nbrs = spark.createDataFrame([(1, a, b) for a, b in {x for a, b in links for x in ((a, b), (b, a))}], "now long, node long, other long")
    seeds = [*range(0, 41, 3), 99]  # 99 has no neighbour
    got = C.expand_traced(spark.createDataFrame([(1, s) for s in seeds], "now long, seed long"), nbrs, hops, degree, cap).collect()
    assert len(got) == len(seeds)
    for x in got:
        assert (sorted(n.node for n in x.nodes), x.hops_completed, x.hub_blocked, x.truncated, x.exhausted, x.hit_node_cap) == plain_trace(links, x.seed, hops, degree, cap)


def test_staged_tables_follow_their_files(spark, tmp_path):
    from loomgraph.operators.stage import once, stage

    path = f"file://{tmp_path}/t"
    count = lambda: once(spark, path, "n", lambda: stage(spark.read.parquet(path))).count()
    spark.range(5).write.parquet(path)
    assert (count(), count()) == (5, 5)
    spark.range(9).write.mode("overwrite").parquet(path)
    assert count() == 9


def test_expansion_from_several_nodes_and_coverage(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11)]
    nbrs = spark.createDataFrame([(1, a, b) for x, y in links for a, b in ((x, y), (y, x))], "now long, node long, other long")
    starts = spark.createDataFrame([(1, 7, [1, 10])], "now long, seed long, nodes array<long>")
    got = C.expand_from(starts, nbrs).first()
    assert sorted((x.node, x.hop) for x in got.nodes) == [(1, 0), (2, 1), (3, 2), (10, 0), (11, 1)]
    rings = spark.createDataFrame([(1, 7, n, 5) for n in (1, 2, 3, 4, 5)] + [(1, 8, n, 3) for n in (20, 21, 22)], "now long, ring long, node long, ring_size long")
    c = E.coverage(rings, spark.createDataFrame([(1, 1), (1, 99)], "now long, seed long"), nbrs).collect()
    assert [(r.ring, r.n_seeds, r.coverage) for r in c] == [(7, 1, 0.6)]


def test_shape_of_large_amounts_keeps_its_digits(spark):
    import random

    r = random.Random(6)
    amounts = [1e7 + r.expovariate(1) for _ in range(60)]
    e = spark.createDataFrame([(i, 1, 2, 5 * i, a) for i, a in enumerate(amounts)], "seq long, src long, dst long, t long, amount double")
    got = X.stats_as_of(e, spark.createDataFrame([(600, 1)], "now long, node long")).first()
    m = sum(amounts) / 60
    m2, m3, m4 = (sum((a - m) ** k for a in amounts) / 60 for k in (2, 3, 4))
    assert got.o_mean == pytest.approx(m) and got.o_std == pytest.approx(m2**0.5, rel=1e-5)
    assert got.o_skew == pytest.approx(m3 / m2**1.5, rel=1e-4) and got.o_kurt == pytest.approx(m4 / m2**2 - 3, rel=1e-3)
    assert (got.o_lo, got.o_hi) == (pytest.approx(min(amounts)), pytest.approx(max(amounts)))


def test_expansions_hang_on_degrees_not_on_a_number_of_nodes(spark, tmp_path):
    from datetime import datetime

    from loomgraph.plans import core

    # account 1 pays 40 others, each of which pays 8 more: 361 nodes, all within the degrees
    sent = [(9999, 1)] + [(1, 100 + i) for i in range(40)] + [(100 + i, 1000 + 10 * i + j) for i in range(40) for j in range(8)]
    rows = [(k, datetime(2024, 1, 1, 6, 30), a, "view", 1.0, f'{{"k": {b}}}') for k, (a, b) in enumerate(sent)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    m = [r for r in core._member(spark, str(tmp_path))[0].collect() if r.seed == 1]
    assert len(m) == 362 and sorted({(r.hop) for r in m}) == [0, 1, 2]
    assert core._inner(spark, str(tmp_path))[0].filter("seed = 1").first().size >= 42
    nbrs = spark.createDataFrame([(1, x, y) for a, b in sent for x, y in ((a, b), (b, a))], "now long, node long, other long")
    far = [1000 + 10 * i + j for i in range(40) for j in range(8)]
    rings = spark.createDataFrame([(1, 7, n, 321) for n in [1, *far]], "now long, ring long, node long, ring_size long")
    assert E.coverage(rings, spark.createDataFrame([(1, 1)], "now long, seed long"), nbrs).first().coverage == 1.0


def test_rounding_scales_and_does_not_read_the_text(spark):
    from loomgraph.functions import scalars as S

    df = spark.createDataFrame([(41 / 640,), (-41 / 640,), (0.25,), (None,)], "x double")
    assert [r[0] for r in df.select(S.rounded("x", 6)).collect()] == [0.064062, -0.064062, 0.25, None]  # 41 / 640 is a little less than 0.0640625 at a million times


def test_transaction_level_without_anything_flagged_or_hit(spark):
    import math

    live = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 3, 0), (1, 4, 5, 0)], "now long, src long, dst long, label int")
    cand = lambda *nodes: spark.createDataFrame([(1, "k", list(nodes))] if nodes else [], "now long, key string, nodes array<long>")
    x = E.transaction_level(live, cand()).first()
    assert (x.n, x.pos, x.flagged, x.tp, x.recall, x.f1) == (3, 1, 0, 0, 0.0, 0.0) and math.isnan(x.precision) and math.isnan(x.lift)
    x = E.transaction_level(live, cand(4, 5)).first()
    assert (x.flagged, x.tp, x.precision, x.recall, x.f1, x.lift) == (1, 0, 0.0, 0.0, 0.0, 0.0)
    x = E.transaction_level(live, cand(1, 2, 3)).first()
    assert (x.flagged, x.tp, x.precision, x.recall, x.f1, x.lift) == (2, 1, 0.5, 1.0, 0.666667, 1.5)
    x = E.transaction_level(live.filter("label = 0"), cand(2, 3)).first()
    assert (x.flagged, x.precision, x.f1) == (1, 0.0, 0.0) and math.isnan(x.recall) and math.isnan(x.lift)
