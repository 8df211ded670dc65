"""SimHash fingerprints and their near-duplicate groups by anchor points of a covering code.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most one bit of one of three segments
(21, 21 and 22 bits). On each segment the anchors are a covering code: the Hamming code on 15 bits with all
values of the others, covering radius 1. A fingerprint goes to every anchor within covering radius plus
threshold (1 + 1) of its segment, so any two fingerprints that close meet at an anchor: the first one's own.
At an anchor they are compared on all 64 bits.

Copies count once: comparisons are between distinct fingerprints. A task links what it finds in a forest, so
a group of n near copies makes n - 1 links and not n squared.

Null and empty texts have fingerprint zero and are linked like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import annotate, stored
from loomgraph.llm.components import components

SEED, SHINGLE, BITS, THRESHOLD = 42, 4, 64, 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 hashes (repeats included)."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([h(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with _fingerprint, a signed long of the 64 bits."""
    return annotate(docs, "text", lambda texts: [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))], "_fingerprint long")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Of the Hamming code: bit i of a value stands for the check i + 1."""
    out = np.zeros(len(values), np.uint64)
    for i in range(CODE_BITS):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def _patterns(width: int, radius: int) -> list[np.ndarray]:
    """By syndrome: the bit changes within ``radius`` that turn a value of that syndrome into an anchor."""
    bits = [1 << i for i in range(width)]
    found = [0, *bits]
    for _ in range(radius - 1):
        found = sorted({x | b for x in found for b in bits} | set(found))
    found = np.array(sorted(found), np.uint64)
    s = _syndromes(found)
    return [found[s == np.uint64(k)] for k in range(CODE_BITS + 1)]


def to_anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor number, index of the fingerprint) of every anchor that a fingerprint goes to."""
    anchors, index = [], []
    for k, (at, width) in enumerate(SEGMENTS):
        own = (values >> np.uint64(at)) & np.uint64((1 << width) - 1)
        s = _syndromes(own)
        for syndrome, changes in enumerate(_patterns(width, 2)):
            who = np.flatnonzero(s == np.uint64(syndrome))
            anchors.append(((own[who, None] ^ changes[None, :]) | np.uint64(k << 22)).ravel().astype(np.int64))
            index.append(np.repeat(who, len(changes)))
    return np.concatenate(anchors), np.concatenate(index)


def linked(anchor: np.ndarray, values: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links between values at one anchor that differ in at most ``threshold`` bits, thinned to a forest."""
    order = np.lexsort((values, anchor))
    anchor, values = anchor[order], values[order]
    nodes, me = np.unique(values, return_inverse=True)
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    last = np.searchsorted(anchor, anchor, "right")
    live, d = np.arange(len(anchor)), 0
    while len(live):
        d += 1
        live = live[live + d < last[live]]
        near = live[np.bitwise_count(values[live] ^ values[live + d]) <= threshold]
        near = near[root[me[near]] != root[me[near + d]]]
        if len(near):
            for i, j in zip(me[near].tolist(), me[near + d].tolist(), strict=True):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def near_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of ``prints`` (_fingerprint) within the threshold."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                values = b.column(0).slice(at, 20_000).to_numpy().view(np.uint64)
                anchors, index = to_anchors(values)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.astype(np.int32)), pa.array(values[index].view(np.int64))], ["anchor", "f"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if got:
            a, b = linked(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    at = prints.select("_fingerprint").mapInArrow(spread, "anchor int, f long")
    return at.repartition("anchor").mapInArrow(compare, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, _fingerprint, stored) with component_id, the smallest doc_id reachable by links, and ``_root``, which names the component."""
    copies = stored(prints.groupBy("_fingerprint").agg(F.min("doc_id").alias("_first")), "fingerprints")
    roots = components(near_links(copies))
    named = copies.join(roots, copies["_fingerprint"] == roots["node"], "left").select("_fingerprint", "_first", F.coalesce("root", "_fingerprint").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    classes = stored(named.join(least, "_root").select("_fingerprint", "component_id", "_root"), "classes")
    return prints.join(classes, "_fingerprint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "prints")
    return groups(prints).select("doc_id", F.lower(F.lpad(F.hex("_fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group, the one with the smallest doc_id, columns as they were; rows without an id stand for no group and stay.

    Rows are what groups are made of: several texts under one doc_id are each judged by their own group, so none goes but for a near copy that stays.
    Of rows of one doc_id and fingerprint the one whose text, then whose other columns come first stays.
    """
    known = docs.filter("doc_id is not null")
    prints = stored(fingerprints(known.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "prints")
    first = groups(prints).groupBy("_root").agg(F.min(F.struct("doc_id", "_fingerprint")).alias("f")).select("f.*")
    many = stored(prints.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id"), "repeated-ids")
    first = stored(first, "kept")
    alone = known.join(first.join(many, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    several = fingerprints(known.join(many, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col("doc_id").cast("long").alias("_id"), "text"))
    order = Window.partitionBy("_id", "_fingerprint").orderBy("text", F.to_json("_all"))
    chosen = several.join(first.withColumnRenamed("doc_id", "_id"), ["_id", "_fingerprint"], "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("_all.*")
    return alone.select(docs.columns).unionByName(chosen.select(docs.columns)).unionByName(docs.filter("doc_id is null"))
