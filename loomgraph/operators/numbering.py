"""Gapless numbers in a given order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.stage import stage


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """``df`` with the long ``name``: start, start + 1, ... in the order of the columns ``order``; rows alike in all of them are numbered in any order.

    Rows are dealt by ranges of ``order`` and sorted where they lie, then written once; a row's number is the rows of all
    ranges before its own and its place there. Only a row per range is summed up in one task. Rows alike in ``order`` are
    parted by their place in the input, so no key is too large for a range; ``df`` is read twice (bounds, rows), so store it first where it is dear.
    """
    if clash := {name, "_tie", "_at", "_range", "_base"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    dealt = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "_tie").sortWithinPartitions(*order)
    rows = stage(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    ranges = rows.groupBy(part.alias("_range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ranges.select("_range", before.alias("_base"))  # a row per range
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.withColumn("_range", part).join(F.broadcast(base), "_range")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + place + start).alias(name))


def total_before(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with the sum ``name`` of ``value`` over all rows before a row in the order of the columns ``order``, in which no two rows are alike.

    Ranges are summed up first; a running sum goes over one range's rows only.
    """
    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    ranges = rows.groupBy("_range").agg(F.sum(value).alias("_v"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("_range", F.coalesce(F.sum("_v").over(upto), F.lit(0)).alias("_base"))  # a row per range
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(base), "_range").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + own).alias(name))
