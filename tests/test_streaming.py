"""Stateful replay: restarts, quiet ticks, late rows and moments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import replay as P


def stream(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, t long, amount double")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    return [(r.randint(0, 6), 7 + r.randint(0, 5), t, round(r.random() * 100, 2)) for t in sorted(r.randint(0, 3000) for _ in range(150)) if not 1000 < t < 1600]


def result(spark, rows, tmp_path, name, number):
    folder = f"file://{tmp_path}/{name}{number}"
    late = P.replay(spark, stream(spark, rows), folder, (name,), number)[name]
    table = P.ticks(spark, folder) if name == "ticks" else P.accounts(spark, folder)
    digits = lambda x: tuple(round(v, 4) if isinstance(v, float) else v for v in x)
    return late, sorted(digits(x) for x in table.drop("as_of").collect())


@pytest.mark.parametrize("name", ["ticks", "accounts"])
def test_restarts_give_the_table_of_an_unbroken_run(spark, rows, tmp_path, name):
    one, three = result(spark, rows, tmp_path, name, 1), result(spark, rows, tmp_path, name, 3)
    assert one[1] == three[1] and one[0] == [0] and three[0] == [0, 0, 0]
    if name == "ticks":
        ticks = [x[0] for x in one[1]]
        assert ticks == list(range(ticks[0], ticks[-1] + 1, 60)) and 0 in [x[1] for x in one[1]] and sum(x[1] for x in one[1]) == len(rows)
    else:
        seen = {x[0] for x in rows} | {x[1] for x in rows}
        assert {x[0] for x in one[1]} == seen


def test_late_rows_reach_no_state_and_are_counted(spark, tmp_path):
    folder = f"file://{tmp_path}/late"
    P.deliver(P.edge_rows(stream(spark, [(1, 2, 10, 1.0), (1, 2, 500, 1.0)])), folder)
    assert P.advance(spark, folder, "ticks") == 0
    P.deliver(P.edge_rows(stream(spark, [(1, 2, 20, 5.0), (3, 3, 20, 5.0), (1, 2, 441, 2.0), (1, 2, 440, 9.0)])).union(P.signal(spark, 600)), folder)
    assert P.advance(spark, folder, "ticks") == 2  # 20 and 440: the watermark is at 500 - 60; the self-loop is no edge
    got = {r.tick_end: (r.n, r.amount) for r in P.ticks(spark, folder).collect()}
    assert got == {60: (1, 1.0), **{e: (0, 0.0) for e in range(120, 480, 60)}, 480: (1, 2.0), 540: (1, 1.0)}


def test_moments_merge_without_losing_digits():
    r = np.random.default_rng(2)
    x = 1e9 + r.normal(0, 1, 5000) ** 2
    state = (0, 0.0, 0.0, 0.0, 0.0, 0.0, float("inf"), float("-inf"))
    for part in np.array_split(x, 13):
        state = P.merged(state, part)
    n, mean, var, skew, kurt, total, low, high = P.shape(state)
    c = x - x.mean()
    assert n == 5000 and abs(mean - x.mean()) < 1e-6 and (low, high) == (x.min(), x.max())
    assert var == pytest.approx((c**2).mean(), rel=1e-5)
    big = 1e5 + r.normal(0, 1, 5000) ** 2
    state = P.merged(P.merged((0, 0.0, 0.0, 0.0, 0.0, 0.0, float("inf"), float("-inf")), big[:17]), big[17:])
    c = big - big.mean()
    assert P.shape(state)[3:5] == pytest.approx(((c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3), rel=1e-6)
    assert P.shape(P.merged((0, 0.0, 0.0, 0.0, 0.0, 0.0, float("inf"), float("-inf")), np.array([5.0, 5.0, 5.0, 5.0])))[2:5] == (0.0, 0.0, 0.0)


def test_an_empty_replay(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert P.replay(spark, stream(spark, []), folder, ("ticks",), 2) == {"ticks": [0, 0]}
    assert P.ticks(spark, folder).count() == 0


def test_accounts_share_state_and_calls_by_shards(spark, tmp_path):
    rows = [(1, 10 + i, 5 * (i % 600), float(i % 7)) for i in range(2500)]
    folder = f"file://{tmp_path}/shards"
    assert P.replay(spark, stream(spark, rows), folder, ("accounts",), 2)["accounts"] == [0, 0]
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    assert 500 < own.read.format("statestore").load(f"{folder}/accounts-state").count() <= 1024  # a call of Python each, not 2,501
    got = {r.node: (r.out_n, r.in_n, r.first_t, r.last_t, r.last_out, r.first_in, r.out_total + r.in_total) for r in P.accounts(spark, folder).collect()}
    want = {10 + i: (0, 1, t, t, None, t, x) for i, (_, _, t, x) in enumerate(rows)}
    assert got == want | {1: (2500, 0, 0, 2995, 2995, None, sum(x for *_, x in rows))}


def test_late_rows_reach_no_account(spark, tmp_path):
    folder = f"file://{tmp_path}/late-accounts"
    P.deliver(P.edge_rows(stream(spark, [(1, 2, 10, 1.0), (1, 2, 2000, 3.0)])), folder)
    assert P.advance(spark, folder, "accounts") == 0
    P.deliver(P.edge_rows(stream(spark, [(1, 3, 1940, 9.0), (1, 3, 1941, 2.0)])).union(P.signal(spark, 3000)), folder)
    assert P.advance(spark, folder, "accounts") == 2  # both ends of the edge at the watermark
    got = {r.node: (r.as_of, r.out_n, r.in_n, r.out_total) for r in P.accounts(spark, folder).collect()}
    assert got == {1: (2880, 3, 0, 6.0), 2: (2880, 0, 2, 0.0), 3: (2880, 0, 1, 0.0)}
