"""Keys, digests and refusals of stored corpora; refusal of arms that don't share cycles."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import arms as A
from loomgraph.operators import corpus_store as K

KEY = K.CorpusKey("events", "constructed", "abc")


def test_digest_hangs_on_rows_only(spark):
    rows = [(i % 7, float(i % 5), None if i % 3 else "x") for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b double, c string")
    d = K.digest(df)
    assert d == K.digest(df.repartition(9)) == K.digest(df.orderBy(F.rand(3)).coalesce(1)) == K.digest(df.select("c", "a", "b"))
    assert d != K.digest(df.limit(199)) and d != K.digest(df.union(df.limit(1))) and d != K.digest(df.withColumn("a", F.when(F.col("a") == 6, 5).otherwise(F.col("a"))))
    assert K.digest(df.limit(0)) == K.digest(df.limit(0))


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(i, i / 3) for i in range(50)], "id long, score double")
    path = f"file://{tmp_path}/c"
    key = K.save(df, KEY, path)
    assert K.load(spark, path, KEY).count() == 50 and K.load(spark, path, key).count() == 50
    for wrong in (K.CorpusKey("other", "constructed", "abc"), K.CorpusKey("events", "given", "abc"), K.CorpusKey("events", "constructed", "zzz"), K.CorpusKey("events", "constructed", "abc", "0")):
        with pytest.raises(K.CorpusMismatch):
            K.load(spark, path, wrong)
    df.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(K.CorpusMismatch, match="not those that were written"):
        K.load(spark, path, KEY)


def test_a_changed_weight_is_refused(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.25, 0.5)], "score double, x double")
    K.verify_scoring(df, "score", F.col("x") * 0.5)
    with pytest.raises(K.CorpusDrift, match="2 of 2"):
        K.verify_scoring(df, "score", F.col("x") * 0.6)


def test_config_hash_hangs_on_content(spark):
    a = K.config_hash({"A": 1, "B": {"x", "y"}}, ["f", "g"], "constructed")
    assert a == K.config_hash({"B": {"y", "x"}, "A": 1}, ["f", "g"], "constructed") and len(a) == 16
    assert len({a, K.config_hash({"A": 2, "B": {"x", "y"}}, ["f", "g"], "constructed"), K.config_hash({"A": 1, "B": {"x", "y"}}, ["g", "f"], "constructed"), K.config_hash({"A": 1, "B": {"x", "y"}}, ["f", "g"], "given")}) == 4
    with pytest.raises(ValueError, match="provenance"):
        K.config_hash({}, [], "else")


def test_pooling_is_refused_where_it_would_mean_nothing(spark):
    given = K.CorpusKey("events", "given", "abc")
    assert K.require_poolable([KEY, KEY], "recall") == "constructed"
    assert K.require_poolable([KEY, given], "scorer") == "constructed+given"
    for keys, question in (([KEY, given], "recall"), ([KEY, given], "anything"), ([KEY, K.CorpusKey("other", "constructed", "abc")], "scorer")):
        with pytest.raises(K.CorpusMismatch):
            K.require_poolable(keys, question)
    with pytest.raises(ValueError):
        K.require_same_dataset([])
    df = spark.createDataFrame([(1,)], "a long")
    assert {k: v.count() for k, v in K.stratified([(KEY, df), (given, df), (KEY, df)], "provenance").items()} == {"constructed": 2, "given": 1}


def test_arms_without_the_same_cycles_are_refused(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1, 5), ("a", 2, 5, 0, 5), ("b", 1, 5, 2, 5)], "arm string, now long, k int, hit long, n long")
    with pytest.raises(ValueError, match="don't share cycles"):
        A.merged(rows, "a", "b")
    whole = rows.union(spark.createDataFrame([("b", 2, 5, 1, 5)], rows.schema))
    r = A.seeding_ratio(A.merged(whole, "a", "b"), 200).first()
    assert r.ratio == pytest.approx(3) and r.low <= r.ratio <= r.high
    assert {(x.arm, x.p) for x in A.precision(whole).collect()} == {("a", 0.1), ("b", 0.3)}


def test_an_arm_without_any_row_leaves_nothing_to_set_side_by_side(spark):
    rows = spark.createDataFrame([("b", 1, 5, 2, 5), ("b", 2, 5, 0, 5)], "arm string, now long, k int, hit long, n long")
    assert A.merged(rows, "a", "b").count() == A.merged(rows, "b", "a").count() == A.merged(rows.limit(0), "a", "b").count() == 0
    assert A.seeding_ratio(A.merged(rows, "a", "b"), 20).count() == 0
