"""Queries of the corpus store: a saved and reloaded corpus, its scores recomputed, its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.operators import corpus_store as K
from loomgraph.operators import features as X
from loomgraph.operators.stage import once
from loomgraph.plans.features import TO_SCORE, built
from loomgraph.plans.further import _folder
from loomgraph.plans.graph import recursive
from loomgraph.plans.registry import query

CONSTANTS = {k: getattr(config, k) for k in ("TICK", "WINDOW", "STEP", "MAX_DEGREE", "MAX_NODES", "MIN_NODES", "MIN_EDGES")}


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their features, saved and loaded under their key."""

    def make() -> DataFrame:
        rows = X.with_score(built(spark, d)).drop("contrib")
        path = f"{_folder(spark, 'corpus')}/c"
        key = K.save(rows, K.CorpusKey("events", "constructed", K.config_hash(CONSTANTS, rows.columns, "constructed")), path)
        return K.load(spark, path, key)

    return once(spark, f"{d}/events.parquet", "corpus", make)


@query("src_corpus_load", recursive(*TO_SCORE) + "SELECT now, key, size, CAST(n_edges AS BIGINT) AS n_edges, round(score, 4) AS score FROM scored")
def _(spark, d):
    return _corpus(spark, d).select("now", "key", "size", "n_edges", F.round("score", 4).alias("score"))


@query("co_verify_scoring", recursive(*TO_SCORE) + "SELECT 'as stored' AS weights, count(*) AS n, 0::BIGINT AS n_drift FROM f UNION ALL SELECT 'conservation twice', count(*), count(*) FILTER (conservation >= 1e-5) FROM f")
def _(spark, d):
    rows = _corpus(spark, d)
    total = lambda twice: F.round(sum((v.cast("double") * (0.0 if k in config.RETIRED else config.WEIGHTS[k] / config.SCALE * (2 if k == twice else 1)) for k, v in X.terms().items()), F.lit(0.0)), 6)
    arms = [K.drift(rows, "score", total(k), 1.1e-6).select(F.lit(name).alias("weights"), "n", "n_drift") for name, k in (("as stored", ""), ("conservation twice", "conservation"))]
    return arms[0].union(arms[1])
