"""Sinks: the compiled stream as day-partitioned Parquet, and append-only JSON logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stream_table(edges: DataFrame, path: str) -> DataFrame:
    """Write ``edges`` (t in minutes) by day, each file in order of time and sequence; return the table read back."""
    dealt = edges.withColumn("day", F.floor(F.col("t") / 1440).cast("int")).repartitionByRange("day", "t").sortWithinPartitions("day", "t", "seq")
    dealt.write.mode("overwrite").partitionBy("day").parquet(path)
    return edges.sparkSession.read.schema(dealt.schema).parquet(path).select(edges.columns)


def append_events(events: DataFrame, path: str) -> None:
    """Add ``events`` to an append-only JSON log; nothing written before is touched.

    Each row gets ``event_id``, a digest of its columns, unless it has one. A write that is tried again adds rows of the same ids, which
    ``readers.events`` counts once.
    """
    names = sorted(c for c in events.columns if c != "event_id")
    own = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    (events if "event_id" in events.columns else events.withColumn("event_id", own)).write.mode("append").json(path)
