"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed counts of character 1- to 3-grams of a text's letters (lower case, other characters as one
space). Document frequencies come from all documents to learn from. The weights are learned by follow-the-
regularised-leader with elastic-net penalties on a bounded sample of labelled documents per language; a
temperature fitted on a part of it kept back turns scores into probabilities.

Learned from rows with a language and text whose crc32(doc_id as text) mod 5 is not 0. A text that is null,
empty or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import annotate, as_bytes

BUCKETS = 1 << 15
LETTER, NOT_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")  # marks are parts of words


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their counts."""
    letters = NOT_LETTERS.sub(" ", (text or b"").decode("utf-8", "replace").lower()).strip()
    if not LETTER.search(letters):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    two = c[:-1] * np.uint64(0x110000) + c[1:]
    three = two[:-1] * np.uint64(0x110000) + c[2:]
    parts = [(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) >> np.uint64(49) for k, x in enumerate((c, two, three))]
    count = np.zeros(BUCKETS, np.int64)
    for p in parts:
        count += np.bincount(p.astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 (the constant) by languages
    temperature: float = 1.0

    def features(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(count)) * self.idf[at]
        v = v / max(np.sqrt((v * v).sum()), 1e-12)
        return np.append(at, BUCKETS), np.append(v, 1.0)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        at, count = grams(text)
        if not len(at) or not self.languages:
            return "und", 0.0
        at, v = self.features(at, count)
        p = _softmax(v @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Of all rows of ``docs`` (text): how many have letters, and how many hold each feature. A task sums up before anything is sent."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t in as_bytes(b.column(0)):
                at, _ = grams(t)
                seen[at] += 1
                seen[BUCKETS] += len(at) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["f", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for f, n in docs.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n")).collect():  # BUCKETS + 1 rows at most
        out[f] = n
    return int(out[BUCKETS]), out[:BUCKETS]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: tuple[str, ...], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 5) -> Model:
    """Follow the regularised leader over ``rows`` (features, counts, language number); a fifth fits the temperature."""
    z, n = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))
    model = Model(languages, idf, z)
    order = np.random.default_rng(seed).permutation(len(rows))
    back, fit = order[: len(rows) // 5], order[len(rows) // 5 :]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in fit:
            at, v = model.features(*rows[i][:2])
            w = weights(at)
            p = _softmax(v @ w)
            p[rows[i][2]] -= 1
            g = v[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    learned = weights(slice(None))
    scores = []
    for i in back:
        at, v = model.features(*rows[i][:2])
        scores.append((v @ learned[at], rows[i][2]))
    best = min(np.geomspace(0.05, 5, 60), key=lambda t: (-sum(np.log(max(_softmax(s / t)[k], 1e-12)) for s, k in scores), abs(np.log(t))))
    return Model(languages, idf, learned, float(best) if scores else 1.0)


def fit(docs: DataFrame, per_language: int = 1000) -> Model:
    """Learn from at most about ``per_language`` documents a language, chosen by a hash of their ids; frequencies from all."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    languages = tuple(sorted(counts))
    if not languages:
        return Model((), np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    total, seen = document_frequencies(known)
    idf = np.log((1 + total) / (1 + seen)) + 1
    share = F.lit(0)
    for k in languages:
        share = F.when(F.col("lang") == k, int(min(1.0, per_language / counts[k]) * (1 << 30))).otherwise(share)
    number = {k: i for i, k in enumerate(languages)}

    def features(b_rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in b_rows:
            got = [grams(t) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([number[x] for x in b.column(0).to_pylist()], pa.int32()), pa.array([g[0].tolist() for g in got], pa.list_(pa.int32())), pa.array([g[1].tolist() for g in got], pa.list_(pa.int32())), b.column(2), b.column(3)], ["k", "at", "n", "h", "h2"])

    sample = known.withColumn("h", F.xxhash64("doc_id")).filter(F.pmod("h", F.lit(1 << 30)) < share).select("lang", "text", "h", F.xxhash64("text", "lang").alias("h2")).mapInArrow(features, "k int, at array<int>, n array<int>, h long, h2 long").toArrow().sort_by([("h", "ascending"), ("h2", "ascending")])
    rows = [(np.array(a, np.int64), np.array(c, np.int64), k) for k, a, c in zip(sample["k"].to_pylist(), sample["at"].to_pylist(), sample["n"].to_pylist(), strict=True) if a]
    return train(rows, languages, idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _lang and _score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def rows(texts: list[bytes | None]) -> list[pa.Array]:
        got = [shared.value.predict(t) for t in texts]
        return [pa.array([x[0] for x in got]), pa.array([x[1] for x in got], pa.float64())]

    return annotate(docs, "text", rows, "_lang string, _score double")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
