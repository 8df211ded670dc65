"""Compiling transactions into the stream table: dense ids, codes, rings, order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.numbering import numbered
from loomgraph.operators.stage import stage
from loomgraph.sources import sinks


def line_order() -> Column:
    """Where a row stands in the text files it was read from: file, block, place. Splits are not read in order, so a row number alone won't do."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def first_seen(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """Dense ids from 0 in order of first appearance of the values of ``columns``, those of one row in the order given: key, id.

    Each value's first place is summed up before anything is sorted, and ids are a range's offset and a place in it, so no task sees all values.
    """
    seen = rows.select(F.posexplode(F.array(*columns)).alias("_side", "key"), F.col(order).alias("_at"))
    first = seen.filter("key is not null").groupBy("key").agg(F.min(F.struct("_at", "_side")).alias("_first"))
    return numbered(stage(first), ["_first"], "id").select("key", "id")


def compile_stream(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write transactions (seq, t, src, dst, amount, channel, label, ring) as the stream table under ``path``.

    Returns the table (ids for ends and channels, by day in order of t and seq), its nodes (key, id) and a row of counts. Accounts of self-loops have
    ids, the loops themselves are no edges.
    """
    rows = stage(rows)
    nodes, channels = stage(first_seen(rows, "seq", "src", "dst")), stage(first_seen(rows, "seq", "channel"))
    edges = rows.filter("src <> dst").join(nodes.select(F.col("key").alias("src"), F.col("id").alias("_src")), "src").join(nodes.select(F.col("key").alias("dst"), F.col("id").alias("_dst")), "dst").join(channels.select(F.col("key").alias("channel"), F.col("id").alias("_channel")), "channel", "left")
    table = sinks.write_stream_table(edges.select("seq", "t", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "amount", F.col("_channel").alias("channel"), "label", "ring"), path)
    loops = F.count(F.when(F.col("src") == F.col("dst"), 1))
    counts = rows.agg(F.count("*").alias("n_rows"), loops.alias("n_self_loops"), (F.count(F.when(F.col("src") != F.col("dst"), 1))).alias("n_edges"), F.count(F.when(F.col("ring") >= 0, 1)).alias("n_ring_edges"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    return table, nodes, counts.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n_nodes"))))  # one row each


def fixture_slice(edges: DataFrame, low: int, high: int, most: int = 150_000) -> tuple[DataFrame, DataFrame]:
    """A small graph for tests out of ``edges`` (seq, t, src, dst, ring, ...): edges in [``low``, ``high``) that touch an account of a ring or its counterparts, and nodes (key, id).

    If there are more than ``most``, all ring edges stay, and of the others every k-th in order of time, so that later cycles don't read a stale window.
    Ids are dense, in order of the ids before. The result hangs on the edges alone.
    """
    cut = stage(edges.filter((F.col("t") >= low) & (F.col("t") < high)))
    ends = lambda df: df.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    marked = lambda df, nodes: df.join(nodes.select(F.col("node").alias("src"), F.lit(1).alias("_s")), "src", "left").join(nodes.select(F.col("node").alias("dst"), F.lit(1).alias("_d")), "dst", "left").filter("_s is not null or _d is not null").select(df.columns)
    kept = stage(ends(marked(cut, stage(ends(cut.filter("ring >= 0"))))))
    touched = stage(marked(cut, kept))
    n, labelled = touched.agg(F.count("*"), F.count(F.when(F.col("ring") >= 0, 1))).first()
    if n > most:
        room = max(0, most - labelled)
        stride = max(1, (n - labelled) // room) if room else n - labelled + 1
        others = numbered(touched.filter("ring < 0"), ["t", "seq"], "_n").filter((F.col("_n") % stride == 0) & (F.col("_n") / stride < room))
        touched = stage(touched.filter("ring >= 0").union(others.select(touched.columns)))
    nodes = stage(numbered(ends(touched).withColumnRenamed("node", "key"), ["key"], "id"))
    dense = touched.join(nodes.toDF("src", "_src"), "src").join(nodes.toDF("dst", "_dst"), "dst")
    return dense.select(*[F.col({"src": "_src", "dst": "_dst"}.get(c, c)).alias(c) for c in edges.columns]), nodes
