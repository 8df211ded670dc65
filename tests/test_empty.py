"""What is asked of no candidates at all."""

from loomgraph.operators import arms as A
from loomgraph.operators import narrative as N

CAND = "now long, key string, seed long, nodes array<long>, size int, score double"


def test_every_order_of_suppression_has_a_row_without_candidates(spark):
    rows = A.suppress_totals(spark.createDataFrame([], CAND)).collect()
    assert sorted((r.arm, r.n_kept, r.n_absorbed) for r in rows) == [(a, 0, None) for a in ("key", "largest", "score", "smallest")]


def test_orders_of_suppression_add_up(spark):
    sets = [(0, "1,2,3", 1, [1, 2, 3], 3, 3.0), (0, "1,2,3,4", 2, [1, 2, 3, 4], 4, 4.0), (0, "7,8,9", 7, [7, 8, 9], 3, 3.0)]
    rows = A.suppress_totals(spark.createDataFrame(sets, CAND)).collect()
    assert {(r.n_kept, r.n_absorbed) for r in rows} == {(2, 1)} and len(rows) == 4


def test_catch_rates_without_reports(spark):
    lines = spark.createDataFrame([], "now long, key string, section int, place int, text string")
    known = spark.createDataFrame([], "now long, key string, id string, kind string")
    assert {(r.fault, r.n, r.caught, r.rate) for r in N.catch_rates(lines, known).collect()} == {("fabricated_id", 0, 0, 1.0), ("stripped_citation", 0, 0, 1.0), ("attribution", 0, 0, 0.0)}
