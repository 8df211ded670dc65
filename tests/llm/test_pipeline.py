"""The pipeline's stages over rows with nulls, repeats, clashing columns and no rows at all; near copies thinned in a defined way."""

import random

import pytest

import corpus_pipeline
from loomgraph.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _all string, _n long, _root string, _words long"
R = random.Random(21)
VOCAB = ["".join(R.choice("abcdeiou") for _ in range(R.randint(2, 7))) for _ in range(900)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


A, B, C = prose(90), prose(90), prose(90)
KEY = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
ROWS = [(1, A), (2, A), (3, B), (3, C), (3, C), (4, B + " more"), (5, None), (6, ""), (None, prose(60)), (None, None), (7, prose(60) + " " + KEY), (8, prose(40) + " the benchmark asks for exactly these ten words in this order here " + prose(30)), (9, "x " * 5000), (10, prose(4000))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "a", 1, "r", 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("parts", [1, 6])
def test_one_row_of_each_group_stays_whatever_its_doc_id_holds(spark, parts):
    kept = simhash.one_of_each(table(spark, ROWS).repartition(parts))
    assert kept.columns == table(spark, ROWS).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect() if r.doc_id not in (None, 4)), key=str)
    # a row of each group, texts of doc_id 3 each by their own; null and empty texts are one group
    assert got == sorted([(1, A), (3, B), (3, C), (5, None), *((i, t) for i, t in ROWS if i is not None and i >= 7)], key=str)
    assert kept.filter("doc_id is null").count() == 2


def folder(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "The benchmark asks for exactly these ten words in this order here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i != 9), 0) for i in range(1, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    from loomgraph.llm.common import stored

    sf_dir = folder(spark, tmp_path, ROWS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 8 not in texts and 9 not in texts and {1, 3, 7, 10} <= texts.keys() and 2 not in texts
    assert "04dbebab" not in texts[7] and len(texts[7]) > 300
    pieces = stored(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir), "packed").collect()
    assert {p.doc_id for p in pieces if p.doc_id is not None} == {k for k in texts if k is not None}


def test_an_empty_table_goes_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0
