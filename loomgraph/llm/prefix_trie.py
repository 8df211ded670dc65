"""A trie of conversations by their turns: which openings they share and what sharing them saves.

Conversations are lists of turns (role, text), told apart by 128 bits of a turn's SHA-256 and its length. Equal conversations are
put together first, so copies cost nothing later. The trie is built in parts: conversations are dealt by the digest
of their first turn, and each task builds the tries of its first turns out of dictionaries and pointers and sums
them up from the leaves without recursion. A first turn with more than ``limit`` turns beneath it is not built in one
task: its conversations are dealt anew by the next turn in which they differ, and so on while a part is too large;
the nodes above the parts (a chain down to the next fork each) are summed up from the parts afterwards, as tables.

Defined cases: rows without a conv_id belong to no conversation; null role or text is empty; turns are in order of ``turn``, null
first, and turns of the same number in order of their digest; more columns are ignored and may have any name. A conversation without turns ends
at the root. An empty table has no node. A conversation's digests are held together (32 bytes a turn), its texts never.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

D = 32  # characters of a turn's digest
NOTHING = hashlib.sha256(b"").hexdigest()
CHUNK_BITS = 10  # ids are joined in stretches of so many bits before they are sent on
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def paths(conversations: DataFrame) -> DataFrame:
    """A row per conv_id: its turns in order, as conv_id, turns array<struct<d, n>> (digest, code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, D)
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.length(text).alias("n")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))  # null turns first
    return own.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``own`` (of ``paths``) with the first h turns of each conversation taken from the one at the ``every`` below, if it exists; h hangs on conv_id."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    none = F.array().cast("array<struct<d:string,n:int>>")
    j = own.withColumn("_base", base).withColumn("_h", h).join(heads, "_base", "left")
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", none), F.lit(1), F.greatest(F.col("_h"), F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return j.select("conv_id", F.concat(head, rest).alias("turns"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """Equal conversations as one row: path, lens, n, least, ends (SHA-256 of their ids in order, comma-joined).

    Ids are joined per stretch of ids before they are sent, and hashed as they stream by, so many copies of one
    conversation need neither a list in memory nor many rows in a task.
    """
    own = convs.select("conv_id", F.array_join("turns.d", "").alias("path"), F.col("turns.n").alias("lens"))
    parts = own.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("stretch")).agg(F.first("lens").alias("lens"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None

        def row(path: str, state: tuple) -> tuple:
            return path, state[0], state[1], state[2], state[3].hexdigest()

        for b in batches:
            done = []
            for p, lens, n, least, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != path:
                    if state:
                        done.append(row(path, state))
                    path, state = p, [lens, n, least, hashlib.sha256(ids.encode())]
                else:
                    state[1] += n
                    state[3].update(b"," + ids.encode())
            if done:
                yield _batch(done)
        if state:
            yield _batch([row(path, state)])

    dealt = parts.repartition("path").sortWithinPartitions("path", "stretch").select("path", "lens", "n", "least", "ids")
    return dealt.mapInArrow(hashed, "path string, lens array<int>, n long, least long, ends string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "lens", "n", "least", "ends"])


def tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the tries of a task's conversations (path, lens, n, least, ends, r, up, up_conv), from depth ``r`` down.

    ``up`` stays with a trie's top node (null elsewhere), to whose parent ``up_conv`` belongs.
    """
    tops: dict[str, int] = {}
    below: list[dict[str, int]] = []  # a node's children by digest
    parent, depth, size, count, least, ends, up = [], [], [], [], [], [], []

    def node(above: int, at: int, length: int) -> int:
        below.append({})
        for column, value in zip((parent, depth, size, count, least, ends, up), (above, at, length, 0, None, NOTHING, None), strict=True):
            column.append(value)
        return len(parent) - 1

    up_convs: dict[int, int] = {}
    for path, lens, n, first, own_ends, r, own_up, up_conv in pdf[["path", "lens", "n", "least", "ends", "r", "up", "up_conv"]].itertuples(index=False, name=None):
        top = path[: D * r]
        at = tops.get(top)
        if at is None:
            at = tops[top] = node(-1, r, int(lens[r - 1]))
            up[at], up_convs[at] = own_up, up_conv
        for d in range(r, len(lens)):
            key = path[D * d : D * d + D]
            child = below[at].get(key)
            if child is None:
                child = below[at][key] = node(at, d + 1, int(lens[d]))
            at = child
        count[at], least[at], ends[at] = n, first, own_ends
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for at in range(len(parent) - 1, -1, -1):  # a node is made after its parent, so children come first here
        leaves[at] += not below[at]
        saved[at] += (count[at] - 1) * size[at]
        if (above := parent[at]) >= 0:
            count[above] += count[at]
            least[above] = least[at] if least[above] is None else min(least[above], least[at])
            leaves[above] += leaves[at]
            saved[above] += saved[at]
    above_conv = [least[p] if p >= 0 else up_convs[i] for i, p in enumerate(parent)]
    return pd.DataFrame({"conv_id": np.array(least, np.int64), "depth": np.array(depth, np.int64), "parent_conv_id": np.array(above_conv, np.int64), "n_convs": np.array(count, np.int64), "n_children": np.array([len(b) for b in below], np.int64), "n_leaves": np.array(leaves, np.int64), "saved_tokens": np.array(saved, np.int64), "ends_sha256": ends, "up": up})


def _forks(groups: DataFrame) -> DataFrame:
    """Parts that are too large: how far all their conversations go together (``to``), and the lengths of the turns on the way."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, chain = [], []
            for low, high, lens, r in zip(*(b.column(c).to_pylist() for c in ("low", "high", "lens", "r")), strict=True):
                d = r
                while D * d < min(len(low), len(high)) and low[D * d : D * d + D] == high[D * d : D * d + D]:
                    d += 1
                to.append(d)
                chain.append(lens[r - 1 : d])
            keep = ["g", "r", "up", "up_conv", "n", "least"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(to, pa.int32()), pa.array(chain, pa.list_(pa.int32()))], [*keep, "to", "chain"])

    return groups.mapInArrow(run, "g string, r int, up string, up_conv long, n long, least long, to int, chain array<int>")


def _chains(spine: DataFrame) -> DataFrame:
    """The nodes of chains (``_forks`` with own_ends, kids, leaves, saved): one row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, up_conv, n, least, to, chain, ends, kids, leaves, saved in zip(*(b.column(c).to_pylist() for c in ("r", "up_conv", "n", "least", "to", "chain", "own_ends", "kids", "leaves", "saved")), strict=True):
                size = to - r + 1
                down = saved + (n - 1) * np.cumsum(np.array(chain, np.int64)[::-1])[::-1]
                last = np.arange(size) == size - 1
                columns = [np.full(size, least), np.arange(r, to + 1), np.where(np.arange(size) == 0, up_conv, least), np.full(size, n), np.where(last, kids, 1), np.full(size, leaves), down]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array([NOTHING] * (size - 1) + [ends])], [f.split()[0] for f in NODE.split(", ")])

    return spine.mapInArrow(run, NODE)


def trie(convs: DataFrame, limit: int = 1000, task: int = 50_000) -> DataFrame:
    """All nodes of the trie of ``convs`` (conv_id, turns as ``paths`` gives them): see ``NODE``.

    ``limit``: the most turns, equal conversations counted once, that are built below one top in a task; ``task``: turns dealt to a task on the whole.
    Rounds go on while a part is larger than ``limit``, one fork deeper each. Every round is written to the shared folder.
    """
    spark = convs.sparkSession
    whole = stored(distinct_paths(convs), "paths")
    n, least = whole.agg(F.sum("n"), F.min("least")).first()
    if n is None:
        return spark.createDataFrame([], NODE)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.expr(f"substring(path, 1, {D} * r)")
    rest = whole.filter("path <> ''").select("*", F.lit(1).alias("r"), F.lit("").alias("up"), F.lit(least).cast("long").alias("up_conv"))
    built, spines = [], []
    while True:
        sizes = rest.groupBy(group.alias("g")).agg(F.sum(F.size("lens") - F.col("r") + 1).alias("turns"))
        sizes = stored(sizes, "sizes")
        large = sizes.filter(F.col("turns") > limit).select("g")
        n_large, turns = sizes.agg(F.count(F.when(F.col("turns") > limit, 1)), F.sum(F.when(F.col("turns") <= limit, F.col("turns")))).first()
        small = rest.withColumn("g", group).join(large, "g", "left_anti") if n_large else rest.withColumn("g", group)
        many = max(buckets, -(-(turns or 0) // task))
        dealt = small.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(many))).select("path", "lens", "n", "least", "ends", "r", "up", "up_conv", "b")
        built.append(stored(dealt.groupBy("b").applyInPandas(tries, NODE + ", up string"), "tries"))
        if not n_large:
            break
        rest = stored(rest.withColumn("g", group).join(large, "g", "left_semi"), "rest")
        parts = rest.groupBy("g").agg(F.first("r").alias("r"), F.first("up").alias("up"), F.first("up_conv").alias("up_conv"), F.sum("n").alias("n"), F.min("least").alias("least"), F.min("path").alias("low"), F.max("path").alias("high"), F.first("lens").alias("lens"))
        spines.append(stored(_forks(parts), "forks"))
        forks = spines[-1].select("g", F.col("least").alias("_least"), "to")
        on = rest.select("g", "path", "lens", "n", "least", "ends").join(forks, "g")
        here = on.filter(F.size("lens") == F.col("to")).select("g", F.col("ends").alias("own_ends"))
        spines[-1] = stored(spines[-1].join(here, "g", "left"), "spine")
        rest = on.filter(F.size("lens") > F.col("to")).select("path", "lens", "n", "least", "ends", (F.col("to") + 1).alias("r"), F.col("g").alias("up"), F.col("_least").alias("up_conv"))
    nodes = built[0].drop("up")
    for b in built[1:]:
        nodes = nodes.union(b.drop("up"))
    sums = [F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")]
    tops = built[-1].filter("up is not null").select("up", "n_leaves", "saved_tokens")
    for t in range(len(spines) - 1, -1, -1):  # from the deepest parts up
        found = tops.groupBy(F.col("up").alias("g")).agg(*sums)
        own = spines[t].join(found, "g", "left").select("g", "r", "up", "up_conv", "n", "least", "to", "chain", F.coalesce("own_ends", F.lit(NOTHING)).alias("own_ends"), F.coalesce("kids", F.lit(0)).alias("kids"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
        chain = stored(_chains(own), "chains")
        nodes = nodes.union(chain)
        length = F.aggregate("chain", F.lit(0).cast("long"), lambda x, y: x + y)
        up = own.select("up", F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * length).alias("saved_tokens"))
        tops = built[t].filter("up is not null").select("up", "n_leaves", "saved_tokens").union(up)
    empty = whole.filter("path = ''").select("ends").first()
    root = tops.agg(*sums).select(F.lit(least).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(n).cast("long"), F.col("kids"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)), F.coalesce("saved", F.lit(0)), F.lit(empty[0] if empty else NOTHING))
    return nodes.union(root.toDF(*nodes.columns))


def shared_openings(conversations: DataFrame, limit: int = 1000) -> DataFrame:
    """The trie of ``conversations`` as they are (conv_id, turn, role, text)."""
    return trie(paths(conversations), limit)


def report(conversations: DataFrame, limit: int = 1000) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(stored(paths(conversations), "turns")), limit)
