"""All queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators import candidates
from loomgraph.plans import arms, casework, core, corpora, evaluation, features, further, graph, learn, ledger, loading, reports, streams, threeday  # noqa: F401  registers its queries
from loomgraph.plans.registry import SPECS, Plan


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked ring candidates: the 50 best of each cycle."""
    return candidates.top_k(features.scored(spark, sf_dir), 50).drop("contrib")


def queries() -> dict[str, Plan]:
    return {k: s.plan for k, s in SPECS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s.sql for k, s in SPECS.items() if s.sql is not None}
