"""Forward replay of the edge stream by Structured Streaming, with state that outlives restarts.

Edges arrive as files, slice by slice in time; each slice is one run of a query with a checkpoint, so a replay is a chain of
restarts. Event time is the edge's minute. Two stateful queries read the stream:

* ``Ticks``: edges and amount per tick, written in append mode once the watermark has passed a tick's end. Ticks
  without edges are written too, as soon as a later one closes. Edges are dealt to a fixed number of shards; a shard keeps open ticks only.
* ``account_shard``: lifetime moments of every account, never expired. An account with news is written when its day ends (a
  timer), so the sink grows by what changed. Accounts are dealt to a fixed number of shards by hash.

Rows at or behind the watermark are late: they reach no state and are counted apart. A row without ends is a clock signal
that only moves the watermark; the last one closes the replay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph import config
from loomgraph.functions.scalars import tick_end

EDGE = "ts timestamp, t long, src long, dst long, amount double"
DAY = 1440
TICKS = "tick_end long, n long, amount double"
SIDES = ("out", "in", "time")
PARTS = ("n", "mean", "m2", "m3", "m4", "total", "low", "high")
SHAPE = ("n", "mean", "var", "skew", "kurt", "total", "low", "high")
MARKS = ("first_t", "last_t", "last_out", "first_in")
NEVER = np.iinfo(np.int64).max  # no day's end, no payment; the last payment made is the negative where there is none
#: What is held of an account: parts of what it paid, was paid, and when; marks that these don't say; the end of the day it is written at, if it has news.
HELD = np.dtype([("node", "<i8"), ("parts", "<f8", (len(SIDES), len(PARTS))), ("last_out", "<i8"), ("first_in", "<i8"), ("due", "<i8")])
ACCOUNT_SHARDS = 1024  # a shard's state is read and written whole, some 230 bytes an account
ACCOUNTS = "node long, as_of long, " + ", ".join(f"{s}_{p} {'long' if p == 'n' else 'double'}" for s in SIDES for p in SHAPE) + ", " + ", ".join(f"{m} long" for m in MARKS)


def _ms(minutes: int) -> int:
    return (int(minutes) + config.EPOCH_MINUTES) * 60_000


def _minutes(ms: int) -> int:
    return ms // 60_000 - config.EPOCH_MINUTES


def sums(x: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, ...]:
    """``PARTS`` of each stretch of ``x`` that begins at ``head``; none is empty."""
    n = np.diff(np.append(head, len(x)))
    total = np.add.reduceat(x, head)
    mean = total / n
    c = x - np.repeat(mean, n)
    return (n.astype(float), mean, *(np.add.reduceat(c**k, head) for k in (2, 3, 4)), total, np.minimum.reduceat(x, head), np.maximum.reduceat(x, head))


def combined(a: Sequence, b: Sequence) -> tuple:
    """``PARTS`` of what ``a`` and ``b`` have seen together, element by element; either may have seen nothing.

    Central sums are merged, never raw powers, so large values keep their digits.
    """
    n1, mean1, a2, a3, a4, total1, low1, high1 = (np.asarray(v, float) for v in a)
    n2, mean2, b2, b3, b4, total2, low2, high2 = (np.asarray(v, float) for v in b)
    d, n = mean2 - mean1, np.maximum(n1 + n2, 1)
    mean = np.where(n1 > 0, mean1 + d * n2 / n, mean2)
    m2 = a2 + b2 + d**2 * n1 * n2 / n
    m3 = a3 + b3 + d**3 * n1 * n2 * (n1 - n2) / n**2 + 3 * d * (n1 * b2 - n2 * a2) / n
    m4 = a4 + b4 + d**4 * n1 * n2 * (n1**2 - n1 * n2 + n2**2) / n**3 + 6 * d**2 * (n1**2 * b2 + n2**2 * a2) / n**2 + 4 * d * (n1 * b3 - n2 * a3) / n
    return n1 + n2, mean, m2, m3, m4, total1 + total2, np.minimum(low1, low2), np.maximum(high1, high2)


def merged(a: tuple, x: np.ndarray) -> tuple:
    """``PARTS`` of what ``a`` has seen and ``x`` together."""
    return tuple(v.item() for v in combined(a, [v[0] for v in sums(x, np.zeros(1, np.int64))])) if len(x) else a


def shape(a: tuple) -> tuple:
    """``SHAPE`` out of ``PARTS``: variance from two values, skewness from three, kurtosis from four, zero without spread."""
    n, mean, m2, m3, m4, total, low, high = a
    flat = m2 <= 1e-18 * max(1.0, mean * mean) * max(n, 1)  # what rounding leaves of equal values
    skew = 0.0 if n < 3 or flat else n**0.5 * m3 / m2**1.5
    kurt = 0.0 if n < 4 or flat else n * m4 / (m2 * m2) - 3
    return n, mean, 0.0 if n < 2 else m2 / n, skew, kurt, total, low if n else 0.0, high if n else 0.0


class Ticks(StatefulProcessor):
    """Key: shard. State: open ticks with their sums, and the last tick written."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ends array<long>, n array<long>, amount array<double>, upto long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).groupby("tick_end")["amount"].agg(["size", "sum"])
        ends, n, amount, upto = self.open.get() if self.open.exists() else ([], [], [], None)
        held = {e: (k, a) for e, k, a in zip(ends, n, amount)}
        for e, k, a in got.itertuples():
            was = held.get(e, (0, 0.0))
            held[e] = (was[0] + int(k), was[1] + float(a))
        self.keep(held, upto)
        yield pd.DataFrame({"tick_end": [], "n": [], "amount": []}).astype({"tick_end": "int64", "n": "int64", "amount": "float64"})

    def keep(self, held: dict[int, tuple[int, float]], upto: int | None) -> None:
        ends = sorted(int(e) for e in held)
        self.open.update((ends, [held[e][0] for e in ends], [held[e][1] for e in ends], upto))
        if ends:
            self.handle.registerTimer(_ms(ends[0]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = _minutes(timerValues.getCurrentWatermarkInMs())
        ends, n, amount, upto = self.open.get()
        held = {e: (k, a) for e, k, a in zip(ends, n, amount)}
        closed = [e for e in ends if e <= now]
        if not closed:
            return
        start = closed[0] if upto is None else upto + config.TICK
        rows = [(e, *held.pop(e, (0, 0.0))) for e in range(start, closed[-1] + 1, config.TICK)]
        self.keep(held, closed[-1])
        yield pd.DataFrame(rows, columns=["tick_end", "n", "amount"])


def account_shard(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Key: shard of accounts. State: ``HELD`` of each of its accounts by number, as bytes; its timer is the first of their days' ends.

    A call of Python costs milliseconds, so accounts share calls; rows come in bounded batches.
    """
    held = np.frombuffer(state.get[0], HELD).copy() if state.exists else np.empty(0, HELD)
    now, news = _minutes(state.getCurrentWatermarkMs()), [np.empty(0, np.int64)]
    for pdf in () if state.hasTimedOut else rows:
        node, out, t, amount = (pdf[c].to_numpy(k) for c, k in (("node", np.int64), ("out", bool), ("t", np.int64), ("amount", float)))
        news.append(np.unique(node))
        held = _with(held, news[-1])
        for k, (use, x) in enumerate(((out, amount), (~out, amount), (np.ones(len(t), bool), t.astype(float)))):
            if use.any():
                order = np.argsort(node[use], kind="stable")
                own, head = np.unique(node[use][order], return_index=True)
                at = np.searchsorted(held["node"], own)
                held["parts"][at, k] = np.stack(combined(held["parts"][at, k].T, sums(x[use][order], head)), axis=1)
        at = np.searchsorted(held["node"], node)
        np.maximum.at(held["last_out"], at[out], t[out])
        np.minimum.at(held["first_in"], at[~out], t[~out])
    at = np.searchsorted(held["node"], np.unique(np.concatenate(news)))
    at = at[held["due"][at] == NEVER]
    held["due"][at] = (np.maximum(held["parts"][at, 2, PARTS.index("high")].astype(np.int64), now) // DAY + 1) * DAY
    done = held[held["due"] <= now]
    held["due"][held["due"] <= now] = NEVER
    state.update((held.tobytes(),))
    if held["due"].min() != NEVER:
        state.setTimeoutTimestamp(_ms(held["due"].min()) - 1)  # a timer runs off once the watermark is beyond it
    if len(done):
        yield _account_rows(done)


def _with(held: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """``held`` and blank rows of those of ``nodes`` that it lacks, by number."""
    new = np.setdiff1d(nodes, held["node"], assume_unique=True)
    if not len(new):
        return held
    blank = np.zeros(len(new), HELD)
    blank["node"], blank["due"], blank["first_in"], blank["last_out"] = new, NEVER, NEVER, -NEVER
    blank["parts"][:, :, -2:] = np.inf, -np.inf
    both = np.concatenate([held, blank])
    return both[np.argsort(both["node"])]


def _account_rows(done: np.ndarray) -> pd.DataFrame:
    shapes = [[v for side in parts for v in shape(side)] for parts in done["parts"].tolist()]
    times = done["parts"][:, 2, -2:].astype(np.int64)
    marks = [times[:, 0], times[:, 1], done["last_out"], done["first_in"]]
    kinds = {c.split()[0]: "Int64" if c.endswith("long") else "float64" for c in ACCOUNTS.split(", ")}
    columns = [done["node"], done["due"], *zip(*shapes, strict=True), *(pd.array(np.where(np.abs(m) == NEVER, 0, m), "Int64") for m in marks)]
    rows = pd.DataFrame(dict(zip(kinds, columns, strict=True))).astype(kinds)
    for name, m in zip(MARKS, marks, strict=True):
        rows.loc[np.abs(m) == NEVER, name] = pd.NA
    return rows


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, t, amount) as rows of the stream."""
    return edges.select(F.timestamp_seconds((F.col("t") + config.EPOCH_MINUTES) * 60).alias("ts"), F.col("t").cast("long").alias("t"), "src", "dst", F.col("amount").cast("double").alias("amount"))


def signal(spark: SparkSession, minutes: int) -> DataFrame:
    """A clock signal: event time has come to ``minutes``."""
    return edge_rows(spark.createDataFrame([(None, None, minutes, None)], "src long, dst long, t long, amount double"))


def deliver(rows: DataFrame, folder: str) -> None:
    """Add files to the stream that reads ``folder``."""
    rows.write.mode("append").parquet(f"{folder}/edges")


def _source(spark: SparkSession, folder: str, delay: int) -> DataFrame:
    # one condition that reads ts, so that it isn't pushed below the watermark, which signals have to reach
    real = F.when(F.col("ts").isNotNull(), F.col("src").isNotNull() & (F.col("src") != F.col("dst")))
    return spark.readStream.schema(EDGE).parquet(f"{folder}/edges").withWatermark("ts", f"{delay} minutes").filter(real)


def tick_stream(spark: SparkSession, folder: str, delay: int, shards: int) -> DataFrame:
    e = _source(spark, folder, delay).select("ts", F.pmod(F.xxhash64("src", "dst"), F.lit(shards)).alias("shard"), tick_end(F.col("t")).alias("tick_end"), "amount")
    return e.groupBy("shard").transformWithStateInPandas(Ticks(), TICKS, "Append", "EventTime")


def account_stream(spark: SparkSession, folder: str, delay: int, shards: int = ACCOUNT_SHARDS) -> DataFrame:
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out")))
    e = _source(spark, folder, delay).select("ts", "t", "amount", F.explode(ends).alias("e")).select("ts", F.pmod(F.xxhash64("e.node"), F.lit(shards)).alias("shard"), "e.node", "e.out", "t", "amount")
    return e.groupBy("shard").applyInPandasWithState(account_shard, ACCOUNTS, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def advance(spark: SparkSession, folder: str, name: str, delay: int = 60, shards: int = 16) -> int:
    """Run the query ``name`` (ticks or accounts) over what has come since its last run, from its checkpoint; returns how many rows were late.

    ``spark``'s own settings stay as they are: the state store is chosen in a session of the query's own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = tick_stream(own, folder, delay, shards) if name == "ticks" else account_stream(own, folder, delay)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Closed ticks, quiet ones with n = 0: tick_end, n, amount."""
    own = spark.read.schema(TICKS).parquet(f"{folder}/ticks")
    return own.groupBy("tick_end").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """The last that was written of every account."""
    own = spark.read.schema(ACCOUNTS).parquet(f"{folder}/accounts")
    return own.groupBy("node").agg(F.max_by(F.struct(*[c for c in own.columns if c != "node"]), "as_of").alias("s")).select("node", "s.*")


def slices(edges: DataFrame, number: int) -> tuple[int, int, DataFrame]:
    """The first and last minute, and ``edges`` with ``slice``, 0 to ``number`` - 1, in stretches of equal length."""
    low, high = edges.agg(F.min("t"), F.max("t")).first()
    if low is None:
        return 0, 0, edges.withColumn("slice", F.lit(0))
    return low, high, edges.withColumn("slice", F.floor((F.col("t") - low) * number / (high - low + 1)))


def replay(spark: SparkSession, edges: DataFrame, folder: str, names: tuple[str, ...] = ("ticks",), number: int = 4, delay: int = 60) -> dict[str, list[int]]:
    """Deliver ``edges`` (src, dst, t, amount) in ``number`` slices, each followed by a run of the queries; the last one closes the replay.

    A column ``slice`` (0 to ``number`` - 1) says when an edge arrives, if that isn't in order of time. Returns the late rows of each
    run per query; an edge counts once for ticks and once per end for accounts.
    """
    low, high, cut = slices(edges.drop("slice"), number)
    cut = edges if "slice" in edges.columns else cut
    late: dict[str, list[int]] = {n: [] for n in names}
    for k in range(number):
        rows = edge_rows(cut.filter(F.col("slice") == k))
        deliver(rows.union(signal(spark, (high // DAY + 1) * DAY + delay)) if k == number - 1 else rows, folder)
        for n in names:
            late[n].append(advance(spark, folder, n, delay))
    return late
