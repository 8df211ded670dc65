"""Stored candidates that say what they were made from, and refuse to answer for anything else.

A corpus is a table and a key: dataset, where its candidates come from, a hash of what makes them, and a digest of the rows that no order or
partitioning changes. Loading asks for a key and compares; scores are recomputed from the stored features before they are trusted.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCES = ("constructed", "given")
#: Whether corpora of both provenances may be pooled for a question: recall means another event on either side.
POOLABLE = {"scorer": True, "ranking": True, "calibration": True, "recall": False, "seeding": False, "build": False, "funnel": False}


class CorpusMismatch(RuntimeError):
    """A stored corpus does not answer the question asked."""


class CorpusDrift(CorpusMismatch):
    """Stored scores are not those that today's code gives."""


@dataclass(frozen=True)
class CorpusKey:
    dataset: str
    provenance: str
    config_hash: str
    digest: str = ""


def config_hash(constants: dict[str, object], features: Iterable[str], provenance: str) -> str:
    """Sixteen hex digits over constants, features in order and provenance; the order of keys and of sets doesn't count."""
    if provenance not in PROVENANCES:
        raise ValueError(f"provenance must be one of {PROVENANCES}, not {provenance!r}")
    plain = {k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in constants.items()} | {"feature_names": list(features), "candidate_provenance": provenance}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def digest(df: DataFrame) -> str:
    """Of the rows as a bag: count and sums of two hashes of each row, in columns' name order. Alike for any order and partitioning; repeats count."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    total = lambda *extra: F.coalesce(F.sum(F.xxhash64(*extra, *columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), total(), total(F.lit("second"))).first()
    return hashlib.sha256(f"{sorted(df.columns)}|{n}|{a}|{b}".encode()).hexdigest()[:32]


def save(df: DataFrame, key: CorpusKey, path: str) -> CorpusKey:
    """Write ``df`` and its key under ``path`` (which must be new); returns the key with the digest of what was written."""
    spark = df.sparkSession
    df.write.parquet(f"{path}/rows")
    whole = CorpusKey(key.dataset, key.provenance, key.config_hash, digest(spark.read.parquet(f"{path}/rows")))
    spark.createDataFrame([(json.dumps(asdict(whole)),)], "value string").write.text(f"{path}/key")
    return whole


def key_of(spark: SparkSession, path: str) -> CorpusKey:
    return CorpusKey(**json.loads(spark.read.text(f"{path}/key").first().value))


def load(spark: SparkSession, path: str, expected: CorpusKey) -> DataFrame:
    """The rows under ``path``, if their key is the one expected (its digest only where one is given) and they are what was written."""
    found = key_of(spark, path)
    wrong = [k for k in ("dataset", "provenance", "config_hash", "digest") if getattr(expected, k) not in ("", getattr(found, k))]
    if wrong:
        raise CorpusMismatch(f"{path}: " + ", ".join(f"{k} is {getattr(found, k)!r}, not {getattr(expected, k)!r}" for k in wrong))
    rows = spark.read.parquet(f"{path}/rows")
    if digest(rows) != found.digest:
        raise CorpusMismatch(f"{path}: the rows are not those that were written")
    return rows


def drift(rows: DataFrame, stored: str, again: Column, tolerance: float = 0.0) -> DataFrame:
    """How far recomputed scores are from the stored ones: n, n_drift, worst."""
    gap = F.abs(F.col(stored) - again)
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.coalesce(gap, F.lit(float("inf"))) > tolerance, 1)).alias("n_drift"), F.max(gap).alias("worst"))


def verify_scoring(rows: DataFrame, stored: str, again: Column, tolerance: float = 0.0) -> None:
    """Refuse ``rows`` if any stored score differs from ``again`` by more than ``tolerance``."""
    d = drift(rows, stored, again, tolerance).first()
    if d.n_drift:
        raise CorpusDrift(f"{d.n_drift} of {d.n} stored scores differ, by {d.worst} at most")


def require_same_dataset(keys: Iterable[CorpusKey]) -> str:
    found = sorted({k.dataset for k in keys})
    if not found:
        raise ValueError("there is no corpus")
    if len(found) > 1:
        raise CorpusMismatch(f"datasets {found} share no unit of observation; report them apart")
    return found[0]


def require_poolable(keys: Iterable[CorpusKey], question: str) -> str:
    """The provenance the corpora share, or both, joined, where the question allows it. An unlisted question is refused."""
    keys = list(keys)
    require_same_dataset(keys)
    if question not in POOLABLE:
        raise CorpusMismatch(f"unknown question {question!r}; there are {', '.join(POOLABLE)}")
    found = sorted({k.provenance for k in keys})
    if len(found) > 1 and not POOLABLE[question]:
        raise CorpusMismatch(f"{' and '.join(found)} candidates can't be pooled for {question}")
    return "+".join(found)


def stratified(corpora: Iterable[tuple[CorpusKey, DataFrame]], by: str) -> dict[str, DataFrame]:
    """Corpora of one ``dataset`` or ``provenance`` together, each with a column ``corpus`` (its config hash); never averaged over strata."""
    out: dict[str, DataFrame] = {}
    for key, df in corpora:
        own = df.withColumn("corpus", F.lit(key.config_hash))
        name = getattr(key, by)
        out[name] = out[name].unionByName(own, allowMissingColumns=True) if name in out else own
    return out
