"""Logs that count a retried write once, calibration's gate, ledgers, rank sums."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cases as K
from loomgraph.operators import economics
from loomgraph.operators import evaluate as E
from loomgraph.operators.numbering import total_before
from loomgraph.sources import readers, sinks


def test_a_retried_append_counts_once_and_ties_are_settled(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, at long, v string")
    for _ in range(3):
        sinks.append_events(rows, path)
    assert readers.events(spark, path).count() == 4
    last = {tuple(sorted((r.k, r.v or "") for r in readers.latest_events(spark, path, "k", "at").collect())) for _ in range(3)}
    assert len(last) == 1


def test_calibration_moves_only_terms_whose_interval_leaves_out_one(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        good = r.random() < 0.3
        rows.append((i, "primary", "confirmed_ring" if good else "not_a_ring", {"strong": float(good and r.random() < 0.9 or r.random() < 0.1), "noise": float(r.random() < 0.5), "rare": float(i < 5)}))
    cases = spark.createDataFrame(rows, "case_id long, lane string, verdict string, contrib map<string,double>")
    w = spark.createDataFrame([("strong", 0.4), ("noise", 0.4), ("rare", 0.1), ("other", 0.1)], "term string, weight double")
    ci = K.lift_intervals(cases)
    got = {x.term: x for x in K.calibrated(K.term_evidence(cases), ci, w).collect()}
    assert {k: v.status for k, v in got.items()} == {"strong": "moved", "noise": "ci_includes_one", "rare": "too_few_observations", "other": "not_a_scored_term"}
    assert got["strong"].low > 1 and got["noise"].low <= 1 <= got["noise"].high and got["rare"].low is None
    assert sum(v.new_weight for v in got.values()) == pytest.approx(1) and got["strong"].new_weight > 0.4 > got["noise"].new_weight
    lift = {x.term: x.lift for x in ci.collect()}
    exact = {x.term: x.lift for x in K.term_rates(K.term_evidence(cases)).collect()}
    assert lift["strong"] == pytest.approx(exact["strong"]) and lift["noise"] == pytest.approx(exact["noise"])


def test_draft_ledger(spark):
    events = lambda *o: spark.createDataFrame([(x,) for x in o], "outcome string")
    g = K.draft_ledger(events("llm_filed", "llm_filed", "llm_rejected_uncited", "llm_unavailable")).first()
    assert (g.attempted, g.rejected, g.rejection_rate) == (3, 1, pytest.approx(1 / 3))
    assert K.draft_ledger(events("llm_unavailable")).first().rejection_rate is None
    with pytest.raises(Exception, match="unknown drafting outcome"):
        K.draft_ledger(events("typo")).collect()


def test_console_stats_and_training_rows(spark):
    cases = spark.createDataFrame([(1, "primary", "confirmed_ring", 5, 30.0, {"a": 1.0}), (2, "control", "not_a_ring", 7, 50.0, {"a": 2.0}), (3, "primary", "pending", 9, 10.0, {"a": 3.0})], "case_id long, lane string, verdict string, size int, seconds double, features map<string,double>")
    s = K.console_stats(cases).first()
    assert (s.n, s.pending, s.labelled, s.accounts_per_decision, s.median_seconds) == (3, 1, 2, 2.5, 50.0)
    assert [(r.case_id, r.label, r.features) for r in K.training_rows(cases).orderBy("case_id").collect()] == [(1, 1, {"f_a": 1.0}), (2, 0, {"f_a": 2.0})]


@pytest.mark.parametrize("parts", [1, 7])
def test_rank_sums_and_spearman(spark, parts):
    r = random.Random(2)
    rows = [(r.randint(0, 40), r.random() < 0.5 and r.randint(0, 9) or None) for _ in range(300)]
    df = spark.createDataFrame([(a, float(b) if b is not None else None) for a, b in rows], "x long, y double").repartition(parts)
    per = df.groupBy("x").agg(F.count("*").alias("n"))
    got = {x.x: x.before for x in total_before(per, ["x"], "n", "before").collect()}
    assert got == {v: sum(a < v for a, _ in rows) for v in {a for a, _ in rows}}
    both = [(a, b) for a, b in rows if b is not None]
    rank = lambda v, all_: sum(x < v for x in all_) + (sum(x == v for x in all_) + 1) / 2
    rx, ry = [rank(a, [x for x, _ in both]) for a, _ in both], [rank(b, [y for _, y in both]) for _, b in both]
    m = sum(rx) / len(rx)
    rho = sum((a - m) * (b - m) for a, b in zip(rx, ry)) / (sum((a - m) ** 2 for a in rx) * sum((b - m) ** 2 for b in ry)) ** 0.5
    s = E.spearman(df, "x", "y").first()
    assert s.n == len(both) and s.rho == pytest.approx(rho, abs=1e-6)


def test_costs_by_group(spark):
    g = {(r.input, r.factor): r for r in economics.by_group(spark.createDataFrame([("a", 0.5, 1_200_000.0)], "group string, p double, value double"), factors=(1.0, 10.0)).collect()}
    m = economics.CostModel()
    assert g["minutes_per_case", 1.0].break_even == pytest.approx(m.break_even())
    assert g["recovery_rate", 10.0].break_even == pytest.approx((m.review_cost + 20_000) / (1_200_000 + 20_000))
    ranked = spark.createDataFrame([("a", i, int(i <= 3)) for i in range(1, 31)] + [("b", 1, 0)], "group string, rank int, hit int")
    best = {r.group: r.k for r in economics.best_k_by_group(ranked, (5, 10, 20), 1_200_000.0).collect()}
    assert best == {"a": 5, "b": None}
