"""Hits of the long window come from sets that no node cap has cut."""

import datetime

from loomgraph.plans.registry import SPECS
from loomgraph.plans.threeday import TIGHT


def test_a_ring_around_a_payer_of_many_is_hit(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=2200)
    ring = [(20, k) for k in range(1, TIGHT["max_nodes"] + 10)] + [(1, 20)]
    rows = [(i, t, a, "error", 100.0, f'{{"k": {b}}}') for i, (a, b) in enumerate(ring) if a != b]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.now, r.ring, r.shared) for r in SPECS["ev_hits_72h"].plan(spark, str(tmp_path)).collect()}
    assert (2220, 0, TIGHT["max_nodes"] + 9) in got
