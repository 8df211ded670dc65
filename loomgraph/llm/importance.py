"""Importance resampling: documents drawn by how much more their features occur in a target than in the corpus.

Features are runs of 1 to ``n`` consecutive words (lower case A-Z only, joined by one space), hashed to buckets by the
crc32 of their UTF-8 bytes. A first pass over Arrow batches counts buckets with ``np.bincount`` into one vector per
partition, and ``treeReduce`` merges the vectors. A bucket's gain compares its share of the target with its share of
the corpus. A second pass gathers the broadcast gains, whose size is the number of buckets, and sums them per
document with ``bincount`` weights. Scores add noise that hangs on the doc_id only; the highest are drawn.

Texts are taken whole, in blocks of bounded size. A null or empty text has no feature and weight 0. A null doc_id takes
noise as if it were empty and comes last among equal scores. Repeated rows count as often as they occur. Empty tables
give empty results. Columns beside doc_id and text are left alone and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import annotate, as_bytes, map_batches, stored, wrapped
from loomgraph.operators.numbering import numbered

BUCKETS = 10_000
SCALE = 1000
#: Lower case for A-Z; every other byte below 128 that is no digit or letter parts words.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = 1 << 20  # bytes of a text that are split at once
FEATURES = 1 << 18  # features that are held at once


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``block`` bytes."""
    flat, at = text.translate(TO_WORDS), 0
    while at < len(flat):
        end = flat.find(b" ", at + block)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def features(texts: list[bytes | None], n: int, n_words: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and buckets of all features of ``texts``, in blocks; ``n_words`` (a zero per text) takes the words' counts."""
    rows: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    held = 0
    for row, text in enumerate(texts):
        tail: list[bytes] = []
        for words in word_blocks(text or b""):
            n_words[row] += len(words)
            line = tail + words
            sums: list[int] = [crc32(w) for w in line]
            found = [np.array(sums[len(tail) :], np.uint32)]
            for k in range(1, n):  # a run of k + 1 words goes on from the run of k that it starts with
                sums = [crc32(b" " + w, c) for w, c in zip(line[k:], sums)]
                found.append(np.array(sums[max(0, len(tail) - k) :], np.uint32))
            tail = line[len(line) - n + 1 :] if n > 1 else []
            hashes += found
            rows.append(np.full(sum(map(len, found)), row, np.int64))
            held += len(rows[-1])
            if held >= FEATURES:
                yield np.concatenate(rows), np.concatenate(hashes) % buckets
                rows, hashes, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(hashes) % buckets


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of ``docs`` (text) fall in each bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = as_bytes(b.column(0).slice(at, 256))
                for _, own in features(texts, n, np.zeros(len(texts), np.int64), buckets):
                    total += np.bincount(own, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(parts, 64))))  # a merge takes in about 64 vectors


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: floor(1000 ln of the target's share over the corpus' share), each count one more than found."""
    s_all, t_all, size = int(corpus.sum()), int(target.sum()), len(corpus)
    # math.log and not numpy's, which differs in the last place between machines
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(texts: list[bytes | None], gain: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and floored mean gain of each text."""
    words, count, total = (np.zeros(len(texts), np.int64) for _ in range(3))
    for rows, own in features(texts, n, words, len(gain)):
        count += np.bincount(rows, minlength=len(texts))
        total += np.bincount(rows, weights=gain[own], minlength=len(texts)).astype(np.int64)  # whole numbers below 2 ** 53: exact
    return words, count, np.where(count > 0, total // np.maximum(count, 1), 0)


def noise(doc_id: Column, seed: str) -> Column:
    """A Gumbel draw in thousandths, from the doc_id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def fit(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from all rows of both tables (text)."""
    return gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))


def weights(docs: DataFrame, gain: np.ndarray, n: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score (all long) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # eight bytes a bucket

    def row(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, weigh(as_bytes(b.column(1)), shared.value, n))], ["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    got = map_batches(own, row, "doc_id long, n_words long, n_features long, weight long")
    return got.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranks(docs: DataFrame, gain: np.ndarray, percent: int = 10, min_words: int = 20, n: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs``.

    Of the N rows with ``min_words`` words, the floor(``percent`` N / 100) highest scores have rank 1, 2, ...; equal scores in order
    of doc_id. How many rows have each score is summed up first (scores are whole numbers in a range that hardly grows with
    the input), so only rows from the lowest drawn score up are sorted.
    """
    every = stored(weights(docs, gain, n, seed), "weights")
    long_enough = F.col("n_words") >= min_words
    found = sorted(every.filter(long_enough).groupBy("score").count().collect(), reverse=True)
    draws, cut, seen = percent * sum(r[1] for r in found) // 100, None, 0
    for score, count in found:
        if seen >= draws:
            break
        cut, seen = score, seen + count
    names = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return every.select(*names, F.lit(None).cast("long").alias("rank"))
    high = long_enough & (F.col("score") >= cut)
    first = numbered(every.filter(high).select(*names), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"], "rank", 1)
    rank = F.when(F.col("rank") <= draws, F.col("rank"))
    return first.withColumn("rank", rank).union(every.filter(~high).select(*names, F.lit(None).cast("long")))


def draw(docs: DataFrame, gain: np.ndarray, percent: int = 10, min_words: int = 20, n: int = 1, seed: str = "2024") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, in no order; rows of the doc_id at the very cut stay together."""
    drawn = ranks(docs, gain, percent, min_words, n, seed).filter("rank is not null")
    last = drawn.orderBy(F.col("rank").desc()).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    added = annotate(wrapped(docs), "text", lambda texts: [pa.array(x) for x in weigh(texts, shared.value, n)], "_words long, _features long, _weight long")
    doc_id = F.col("_all.doc_id").cast("long")
    score = F.col("_weight") + noise(doc_id, seed)
    before = F.lit(True) if last.doc_id is None else F.coalesce(doc_id <= last.doc_id, F.lit(False))
    return added.filter((F.col("_words") >= min_words) & ((score > last.score) | ((score == last.score) & before))).select("_all.*")
