"""Sum-of-squares packing of token sequences into bins of a fixed capacity.

A piece goes where the sum, over residual gaps, of the squared count of open bins becomes smallest;
among equals, to the smallest remaining gap. Pieces are dealt at random into groups of a bounded size, longest
first within a group. A group's emptiest bins (a fixed number) are opened again and their pieces go to a
next round of fewer groups, until one is left; so waste doesn't grow with the number of groups and no task's
share grows with the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_batches, stored
from loomgraph.llm.encoding import END_ID, default_vocabulary, encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts (null: empty), end each with id 1, and cut only those longer than ``capacity``."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, blob in zip(b.column(0).to_pylist(), encoder(vocabulary).encode(b.column(1).to_pylist()), strict=True):
            blob += END_ID.to_bytes(4, "little")
            for piece, at in enumerate(range(0, len(blob), 4 * capacity)):
                part = blob[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), cut, PIECE, 1024)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, placed in the order given; lengths are 1 to ``capacity``."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # of open bins by residual gap
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = count[s:]
        there = np.flatnonzero(gaps)
        fresh = 1 + 2 * int(count[capacity - s]) if s < capacity else 0
        gap = -1
        if len(there):
            # moving a bin from gap g to g - s changes the sum by 2 * (N(g - s) - N(g)) + 2, or 1 - 2 * N(g) where it is filled
            cost = np.where(there > 0, 2 * (count[there] - gaps[there]) + 2, 1 - 2 * gaps[there])
            best = int(cost.argmin())
            if cost[best] <= fresh:
                gap = int(there[best]) + s
        if gap < 0:
            b, offset = made, 0
            made += 1
            gap = capacity
        else:
            b, offset = open_bins[gap].pop(), capacity - gap
            count[gap] -= 1
        bins[i], offsets[i] = b, offset
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, group: int = 8192, fan_in: int = 16, reopen: int = 4) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length; more columns stay).

    ``group`` pieces go to a task in the first round. Each round opens the ``reopen`` emptiest bins of a group
    again and hands their pieces to a round of ``fan_in`` times fewer groups. The pieces' table is read once
    per round, so store it first where making it is dear. Empty in, empty out.
    """
    names = pieces.columns
    n = pieces.count()
    groups = max(1, -(-n // group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, done boolean"

    def placed(level: int, last: bool):
        def run(key: tuple, own: pa.Table) -> pa.Table:
            own = own.drop_columns("_g").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            lengths = own["length"].to_numpy()
            bins, offsets = sum_of_squares(lengths, capacity)
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            done = np.ones(len(fill), bool)
            if not last:
                done[np.argsort(fill, kind="stable")[:reopen]] = False
                done |= fill == capacity
            # round, group and bin make up the number; a bin is in one group of one round
            number = (np.int64(level) << 58) | (np.int64(key[0].as_py()) << 24) | bins
            return own.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("done", pa.array(done[bins]))

        return run

    kept, level = [], 0
    while True:
        # a number of the row's own in the stored table: rows that are alike in every column are dealt apart too
        salt = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(level))
        dealt = pieces.withColumn("_g", F.pmod(salt, F.lit(groups))).repartition(groups, "_g") if groups > 1 else pieces.withColumn("_g", F.lit(0).cast("long"))
        out = stored(dealt.groupBy("_g").applyInArrow(placed(level, groups == 1), schema), "packed")
        kept.append(out.filter("done").select(*names, "sequence_id", "offset"))
        if groups == 1:
            break
        pieces = out.filter("not done").select(*names)
        groups, level = -(-groups // fan_in), level + 1
    whole = kept[0]
    for k in kept[1:]:
        whole = whole.unionByName(k)
    return whole


def packed_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces_of(docs, capacity, vocabulary), "pieces"), capacity)


def sequences(packed: DataFrame, docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """The packed ids themselves: sequence_id, ids array<int>, doc_ids array<long> in order of offset."""
    vocabulary = vocabulary or default_vocabulary()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, blob in zip(b.column(0).to_pylist(), encoder(vocabulary).encode(b.column(1).to_pylist()), strict=True):
            ids = np.frombuffer(blob + END_ID.to_bytes(4, "little"), "<u4")
            rows += [(doc_id, k, ids[at : at + capacity].tolist()) for k, at in enumerate(range(0, len(ids), capacity))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["doc_id", "piece", "ids"])

    own = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), cut, "doc_id long, piece int, ids array<int>")
    parts = packed.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
