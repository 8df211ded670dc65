"""Matches of a pattern with their places, by built-in functions alone.

A text is parted at the matches; the parts' lengths give the places in code points and their ends the
context, so no text is cut up once per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 32
ROW, SPAN = "_row", "_span"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """An array of (kind, n, gap, before, hit, after); ``gap`` is the code points since the match before."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(hit: Column, i: Column) -> Column:
        part = F.get(parts, i)
        return F.struct(F.lit(kind).alias("kind"), i.alias("n"), F.length(part).cast("long").alias("gap"), F.right(part, F.lit(CONTEXT)).alias("before"), hit.alias("hit"), F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after"))

    return F.transform(hits, one)


def placed(docs: DataFrame, found: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per match of ``docs`` (one without a match where there is none): _row, ``keep``, _span and start, end.

    Only matches and their contexts are shuffled, never texts; later steps by _row need no further shuffle.
    """
    rows = docs.withColumn(ROW, F.monotonically_increasing_id()).select(ROW, *keep, F.explode_outer(found).alias(SPAN)).repartition(ROW)
    own = Window.partitionBy(ROW, f"{SPAN}.kind").orderBy(f"{SPAN}.n")
    size = F.length(f"{SPAN}.hit")
    end = F.sum(F.col(f"{SPAN}.gap") + size).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - size)
