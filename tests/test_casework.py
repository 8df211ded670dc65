"""Recommendations, calibration, verdicts, identities and links on small tables."""

from loomgraph.operators import cases as K
from loomgraph.operators import economics
from loomgraph.operators import evaluate as E
from loomgraph.operators import identity as I
from loomgraph.operators import links as L


def test_a_recommendation_is_decided_once_and_executed_only_if_approved(spark):
    rows = [
        ("a", 1, "recommend", ["e1"], "why", None, None), ("a", 2, "decide", None, None, "kim", True), ("a", 3, "execute", None, None, None, None), ("a", 4, "decide", None, None, "lee", False),
        ("b", 1, "recommend", ["e1"], "why", None, None), ("b", 2, "decide", None, None, "kim", False), ("b", 3, "execute", None, None, None, None),
        ("c", 1, "recommend", [], "why", None, None), ("d", 1, "recommend", ["e1"], "why", None, None), ("d", 2, "decide", None, None, " ", True),
        ("e", 2, "recommend", ["e1"], "why", None, None), ("e", 1, "execute", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "rec_id string, at long, event string, evidence array<string>, rationale string, by string, approved boolean")
    assert sorted(map(tuple, K.recommendations(df).collect())) == [("a", "APPROVED", True), ("b", "REJECTED", False), ("d", "PENDING", False), ("e", "PENDING", False)]


def test_evidence_weights_the_control_lane_and_leaves_undecided_out(spark):
    rows = [(1, "control", "confirmed_ring", {"x": 0.2}), (2, "primary", "false_positive", {"x": 0.2}), (3, "primary", "insufficient_evidence", {"x": 0.2}), (4, "primary", "confirmed_partial", {"x": 0.0})]
    e = K.term_evidence(spark.createDataFrame(rows, "case_id long, lane string, verdict string, contrib map<string,double>")).first()
    assert (e.fired_n, e.fired_positive, e.not_fired_n, e.raw_fired, e.raw_not_fired) == (11.0, 10.0, 1.0, 2, 1)
    r = K.term_rates(spark.createDataFrame([("y", 2.0, 1.0, 2.0, 0.0, 2, 2), ("z", 2.0, 0.0, 0.0, 0.0, 2, 0)], "term string, fired_n double, fired_positive double, not_fired_n double, not_fired_positive double, raw_fired long, raw_not_fired long"))
    assert {x.term: x.lift for x in r.collect()} == {"y": None, "z": 1.0}


def test_identity_counts_open_triples_from_the_smallest_member(spark):
    rows = [(1, "pan", "p"), (2, "pan", "p"), (1, "phone", "f"), (3, "phone", "f"), (2, "address", "a"), (4, "address", "b")]
    apps = spark.createDataFrame(rows, "app_id long, attribute string, value string")
    m = I.around(apps)
    t = {r.seed: (r.closed, r.open) for r in I.triangles(I.links(I.groups(m, apps))).collect()}
    assert t == {1: (0, 1)}  # 2 and 3 share nothing


def test_links_need_time_order_and_leave_the_bridge_out(spark):
    cand = spark.createDataFrame([(60, "1,2,3", 1, [1, 2, 3], 3), (60, "7,8,9", 7, [7, 8, 9], 3)], "now long, key string, seed long, nodes array<long>, size int")
    p = lambda out, back: spark.createDataFrame([(60, 3, 5, out, out), (60, 5, 7, back, back)], "now long, src long, dst long, first_t long, last_t long")
    got = L.bridges(cand, p(10, 20)).collect()
    assert [(r.key_a, r.key_b, r.bridge, r.merged) for r in got] == [("1,2,3", "7,8,9", [5], [1, 2, 3, 7, 8, 9])]
    assert L.bridges(cand, p(20, 10)).count() == 0


def test_no_ring_is_on_both_sides_of_a_split(spark):
    rows = [(t, f"{t}-{r}", r) for r in range(10) for t in range(r, r + 4)] + [(t, f"{t}", None) for t in range(14)]
    s = E.ring_split(spark.createDataFrame(rows, "now long, key string, ring long")).collect()
    assert not {r.ring for r in s if r.side == "train" and r.ring is not None} & {r.ring for r in s if r.side == "test"}
    assert len(s) == len(rows)


def test_a_narrative_cites_what_it_counts(spark):
    df = spark.createDataFrame([("There are 3 accounts [CASE-1]. They paid 12 times. A person decides.",), (None,)], "text string")
    assert [r.n_uncited for r in K.uncited(df).collect()][0] == 1
    assert {r.input for r in economics.sensitivity(spark).collect()} == {"minutes_per_case", "cost_per_hour", "value_at_risk", "recovery_rate", "harm_per_false_positive"}


def test_identity_components_diameter_and_timing(spark):
    member = spark.createDataFrame([(1, n) for n in range(1, 8)] + [(2, 20), (2, 21)], "seed long, app_id long")
    linked = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 5, 6), (2, 20, 21)], "seed long, u long, v long")
    got = {r.seed: tuple(r)[1:] for r in I.connected(member, linked).collect()}
    assert got == {1: (3, 4, 3, 2), 2: (1, 2, 1, 1)}
    times = spark.createDataFrame([(n, 1440 * d) for n, d in zip([*range(1, 8), 20], [0, 1, 8, 8, 30, 31, 40, 5])], "app_id long, minutes long")
    t = {r.seed: r for r in I.timing(member, times).collect()}
    assert (t[1].span_days, t[1].max_gap_days, round(t[1].burst_index, 4)) == (40.0, 22.0, round(3 / 7, 4))
    assert (t[2].span_days, t[2].mean_gap_days, t[2].burst_index) == (0.0, 0.0, 1.0)


def test_identity_boundary_and_excluded_columns(spark):
    apps = spark.createDataFrame([(1, "pan", "x"), (2, "pan", "x"), (3, "pan", "x"), (3, "phone", "p"), (4, "phone", "p"), (5, "address", "z")], "app_id long, attribute string, value string")
    member = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (5, 5)], "seed long, app_id long")
    assert [tuple(r) for r in I.boundary(member, apps).collect()] == [(1, 1)]
    f = {r.seed: r for r in I.fanouts(member, apps).collect()}
    assert (f[1].max_pan_fanout, f[1].max_phone_fanout, f[1].mean_fanout) == (3, 2, 11 / 4) and f[5].max_pan_fanout == 0
    assert I.feature_names(I.fanouts(member, apps)) == ["max_address_fanout", "mean_fanout"]
