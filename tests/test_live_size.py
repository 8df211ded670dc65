"""How large Spark takes the window to be, which decides on broadcasts."""

from loomgraph.operators import window as W


def _size(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_rows_of_a_wide_window_are_not_taken_for_the_rows_of_the_file(spark, tmp_path):
    spark.createDataFrame([(k, k % 5, k % 7 + 10, 60 * k, 1.0) for k in range(500)], "seq long, src long, dst long, t long, amount double").write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    live = W.live(W.islands(e, 4320), 4320)
    assert _size(live) >= 12 * _size(e) and _size(W.pairs(live)) >= 12 * _size(e)
    plain = sorted((r.seq, now) for r in e.collect() for now in range(60, 43261, 360) if now >= 2160 and r.t // 60 * 60 + 60 <= now < r.t // 60 * 60 + 60 + 4320)
    assert sorted((r.seq, r.now) for r in live.collect()) == plain
