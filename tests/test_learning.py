"""Boosted trees, importances, the non-negative blend, bootstraps and label noise against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import label_tax as T
from loomgraph.operators import learning as L
from loomgraph.operators import resample
from loomgraph.plans import learn

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cases():
    r = np.random.default_rng(5)
    x = np.round(r.normal(0, 1, (500, 3)), 2)
    x[:, 2] = np.round(x[:, 2])
    y = (x[:, 0] + 0.5 * x[:, 2] + r.normal(0, 0.5, 500) > 1.2).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, cases):
    x, y = cases
    return spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))] + [(900, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y int")


def plain_fit(x, y, edges, trees, depth, rate, bins, smooth):
    """Trees by going through every split of every node."""
    n, w = len(y), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    q = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], 1)
    margin = np.zeros(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        nodes = [np.arange(n)]
        for _ in range(depth):
            children = []
            for own in nodes:
                value = lambda i: g[i].sum() ** 2 / (h[i].sum() + smooth) if len(i) else 0.0
                best, cut = 1e-12, None
                for f in range(x.shape[1]):
                    for t in range(bins - 1):
                        left = own[q[own, f] <= t]
                        right = own[q[own, f] > t]
                        if len(left) and len(right) and (gain := value(left) + value(right) - value(own)) > best + 1e-9:
                            best, cut = gain, (left, right)
                children += cut or (own, own[:0])
            nodes = children
        for own in nodes:
            if len(own):
                margin[own] += rate * g[own].sum() / (h[own].sum() + smooth)
    return margin


@pytest.mark.parametrize("parts", [1, 7])
def test_trees_equal_a_plain_version(rows, cases, parts):
    x, y = cases
    model = L.fit(rows.repartition(parts), NAMES, "y", trees=4, depth=3, bins=8)
    expected = plain_fit(x, y, model.edges, 4, 3, 0.1, 8, 1.0)
    got = {r.id: r.p for r in L.scored(rows, model).collect()}
    assert np.allclose([got[i] for i in range(500)], 1 / (1 + np.exp(-expected)), atol=1e-9)


def test_trees_stay_equal_when_rows_keep_their_margin(rows, cases, monkeypatch):
    x, y = cases
    monkeypatch.setattr(L, "KEPT", 2)
    monkeypatch.setattr(L, "HELD", 100)
    model = L.fit(rows, NAMES, "y", trees=5, depth=2, bins=8)
    got = {r.id: r.p for r in L.scored(rows, model).collect()}
    assert len(model.splits) == 5 and np.allclose([got[i] for i in range(500)], 1 / (1 + np.exp(-plain_fit(x, y, model.edges, 5, 2, 0.1, 8, 1.0))), atol=1e-9)


def test_the_queries_learn_as_many_trees_as_the_reference(monkeypatch, rows):
    seen = {}
    monkeypatch.setattr(learn, "_labelled", lambda spark, d: rows.selectExpr("id as now", "*"))
    monkeypatch.setattr(learn, "once", lambda spark, path, name, make: make())
    monkeypatch.setattr(learn.L, "fit_any", lambda rows, features, label, **bounds: seen.update(bounds))
    learn._model(None, "")
    assert seen["trees"] == 200


def ap(score, y):
    order = sorted(set(score), reverse=True)
    out, seen = 0.0, 0.0
    for s in order:
        at = score >= s
        recall = y[at].sum() / y.sum()
        out += (recall - seen) * y[at].mean()
        seen = recall
    return out


def test_ranking_average_precision_and_importances(spark, rows, cases):
    x, y = cases
    model = L.fit(rows.filter("id < 350"), NAMES, "y", trees=15)
    back = rows.filter("id between 350 and 499")
    scored = L.scored(back, model).collect()
    s, t = np.array([r.p for r in scored]), np.array([r.y for r in scored])
    assert L.average_precision(L.scored(back, model), "p", "y").first().ap == pytest.approx(ap(s, t))
    assert ap(s, t) > 2 * t.mean()
    top = L.ranked(back, model, "id").orderBy("rank").collect()
    assert [r.rank for r in top] == list(range(1, 151)) and all((-a.p, a.id) < (-b.p, b.id) for a, b in zip(top, top[1:]))

    known = sorted(zip(y[350:], *x[350:].T))
    v = np.array([k[1:] for k in known])
    yy = np.array([k[0] for k in known])
    expected = {}
    for j, f in enumerate(NAMES):
        drops = []
        for k in range(5):
            a, b = L._shuffle(k * 3 + j, 150, 7)
            w = v.copy()
            w[:, j] = v[(a * np.arange(150) + b) % 150, j]
            drops.append(ap(model.margin(model.binned(list(v.T))), yy) - ap(model.margin(model.binned(list(w.T))), yy))
        expected[f] = np.mean(drops)
    got = {r.feature: r.importance for r in L.importances(back, model, "y").collect()}
    assert got == pytest.approx(expected, abs=1e-9) and got["a"] > 0.1


def test_refusals(rows):
    with pytest.raises(ValueError, match="20 labelled rows"):
        L.fit(rows.filter("id < 19"), NAMES, "y")
    with pytest.raises(ValueError, match="single class"):
        L.fit(rows.filter("y = 0"), NAMES, "y")
    with pytest.raises(ValueError, match="single class"):
        L.blend(rows.filter("y = 0"), NAMES, "y")


@pytest.mark.parametrize("seed", range(20))
def test_nonnegative_least_squares_meets_its_conditions(seed):
    r = np.random.default_rng(seed)
    m = r.normal(0, 1, (30, 7))
    if seed % 3 == 0:
        m[:, 3] = m[:, 1] + m[:, 2]
    b = r.normal(0, 1, 30)
    a, v = m.T @ m, m.T @ b
    x = L.nonnegative(a, v)
    slope = v - a @ x
    assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_blend_weights_add_up_to_one(rows):
    w = L.blend(rows.filter("y is not null").withColumn("a", F.greatest("a", F.lit(0.0))).withColumn("c", F.greatest("c", F.lit(0.0))), ["a", "c"], "y")
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0 and w["a"] > w["c"]


def test_sums_of_no_rows_are_null_and_weigh_nothing(rows):
    none = rows.filter("id < 0")
    assert [tuple(r) for r in L.gram(none, ["a"], "y").collect()] == [(0, 0, None), (0, 1, None), (1, 1, None)]
    assert L.blend(none, NAMES, "y", one_class=True) == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_cluster_bootstrap_equals_a_loop(spark):
    r = random.Random(3)
    trials = [(r.randint(0, 8), r.randint(0, 4), r.randint(0, 1)) for _ in range(60)]
    got = {x.clustering: x for x in resample.cluster_bootstrap(spark.createDataFrame(trials, "now long, ring long, hit long").withColumn("n", F.lit(1)), ["now", "ring"], "hit", "n", 200).collect()}

    def draw(k, j):
        x = (k * 7919 + j * 104729 + 7) % 2147483647
        for _ in range(3):
            x = (x * 48271 + 11) % 2147483647
        return x

    for at, name in enumerate(("now", "ring")):
        keys = sorted({t[at] for t in trials})
        values = sorted(sum(t[2] for t in s) / len(s) for s in ([t for j in range(len(keys)) for t in trials if t[at] == keys[draw(k, j) % len(keys)]] for k in range(200)))
        assert (got[name].low, got[name].high, got[name].n_clusters) == pytest.approx((values[5], values[195], len(keys)))
    assert got["all"].low == min(got["now"].low, got["ring"].low) and got["all"].high == max(got["now"].high, got["ring"].high)


def test_label_noise_is_nested_and_one_way(spark):
    train = spark.createDataFrame([(i, i % 9, int(i % 4 == 0)) for i in range(800)], "id long, cell long, y int")
    arms = T.relabelled(train, (0.0, 0.2, 0.5), 2).collect()
    flipped = {}
    for r in arms:
        assert r.was == 1 or r.y == r.was
        if r.was == 1 and r.y != 1:
            assert r.y == (0 if r.kind == "raw" else None)
            flipped.setdefault((r.rate, r.seed, r.kind), set()).add(r.id)
    assert (0.0, 0, "raw") not in flipped
    for s in (0, 1):
        assert flipped[0.2, s, "raw"] == flipped[0.2, s, "control"] and flipped[0.2, s, "raw"] < flipped[0.5, s, "raw"]
        assert abs(len(flipped[0.5, s, "raw"]) - 100) < 30
    assert flipped[0.5, 0, "raw"] != flipped[0.5, 1, "raw"]


def test_labels_of_one_class_give_a_rate_and_no_error(spark, rows):
    none, every = rows.filter("y = 0"), rows.filter("y = 1")
    model = L.fit_any(none, NAMES, "y", trees=2)
    n = none.count()
    assert not model.splits and {round(r.p, 9) for r in L.scored(none, model).collect()} == {round(1 / (n + 2), 9)}
    assert L.average_precision(L.scored(none, model), "p", "y").first().ap is None
    assert L.average_precision(L.scored(every, L.fit_any(every, NAMES, "y")), "p", "y").first().ap == 1.0
    assert {r.importance for r in L.importances(none, model, "y", 2).collect()} == {None}
    assert {r.importance for r in L.importances(every, L.fit_any(every, NAMES, "y"), "y", 2).collect()} == {0.0}
    assert L.fit_any(rows.filter("id < 3"), NAMES, "y").splits == [] and L.fit_any(rows, NAMES, "y", trees=1).splits
    assert set(L.blend(none, NAMES, "y", one_class=True).values()) == {0.0}
    assert sum(L.blend(every.select("y", *[F.abs(c).alias(c) for c in NAMES]), NAMES, "y", one_class=True).values()) == pytest.approx(1)


def test_only_the_first_ids_of_a_cell_meet_the_arms(spark):
    r = random.Random(3)
    arms = [(rate, seed, "raw", i, r.randrange(4), r.choice([0, 1, None])) for rate in (0.0, 0.5) for seed in (0, 1) for i in range(80)]
    test = [(i, i % 3, r.choice([0, 0, 0, 1, 2, 3, 9]), r.randrange(2)) for i in r.sample(range(9999), 300)]
    got = T.arm_hits(spark.createDataFrame(arms, "rate double, seed int, kind string, id long, cell long, y int"), spark.createDataFrame(test, "id long, cycle long, cell long, y int"), 10)
    expected = {}
    for arm in {a[:3] for a in arms}:
        own = [a for a in arms if a[:3] == arm and a[5] is not None]
        p = lambda x: (sum(a[5] for a in x) + 1) / (len(x) + 2)
        cells = {c: p([a for a in own if a[4] == c]) for c in {a[4] for a in own}}
        for cycle in range(3):
            first = sorted((t for t in test if t[1] == cycle), key=lambda t: (-round(cells.get(t[2], p(own)), 9), t[0]))[:10]
            expected[*arm, cycle] = (sum(t[3] for t in first), len(first))
    assert {(x.rate, x.seed, x.kind, x.cycle): (x.hit, x.n) for x in got.collect()} == expected
