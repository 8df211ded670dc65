"""Shared folders, Arrow helpers and small guards of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only where a local session has no such setting (tests) is a temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("loomgraph.work.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
            spark.conf.set("loomgraph.work.dir", base)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and a lost executor costs nothing.

    Shuffle files that only served the table are of no use any more; Spark removes them once the driver has collected its garbage.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """``stored``, in buckets of the long column ``by``, as many as the session has shuffle partitions: joins on it leave the table where it is.

    The table is entered in the session's catalogue under a name of its own, its files lie in the shared folder.
    """
    spark, table = df.sparkSession, f"loomgraph_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, by).sortBy(by).option("path", work_dir(spark, name)).format("parquet").saveAsTable(table)
    spark.sparkContext._jvm.System.gc()
    return spark.table(table)


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more; what was made from them has to be stored by now."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def flagged(rows: DataFrame, column: str, size: int) -> Broadcast:
    """A bitmap of ``2 ** size`` bits (16 or more) in which those of the low bits of the long ``column`` are set, for ``has_flag`` in tasks.

    Its memory does not grow with ``rows``: more rows set more bits, and less can be told apart.
    """
    low = rows.select(F.col(column).bitwiseAND(F.lit((1 << size) - 1)).alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(0).to_numpy()
            for page in np.unique(x >> 16).tolist():
                own = x[x >> 16 == page] & 0xFFFF
                np.bitwise_or.at(pages.setdefault(page, np.zeros(1 << 13, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        if pages:
            yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([v.tobytes() for v in pages.values()], pa.binary())], ["page", "bits"])

    bits = np.zeros(1 << (size - 3), np.uint8)
    for page, own in low.repartition(16, F.shiftright("x", 16)).mapInArrow(run, "page long, bits binary").toLocalIterator():
        bits[page << 13 : (page + 1) << 13] |= np.frombuffer(own, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


def has_flag(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` may be in the column that ``flagged`` read: all that are, and some others."""
    at = x.astype(np.int64) & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows, so that memory follows the slice and not the batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                out = f(b.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def wrapped(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``_all`` beside ``text``, so that added columns clash with none; ``select("_all.*")`` undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), "text")


def annotate(df: DataFrame, column: str, f: Callable[[list[bytes | None]], list[pa.Array]], added: str, rows: int = 256) -> DataFrame:
    """All columns of ``df`` and those that ``f`` makes of a slice's texts; ``added`` must not clash with ``df``'s names."""
    names = [x.split()[0] for x in added.split(", ")]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    old = [f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema]
    at = df.columns.index(column)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, *f(as_bytes(b.column(at)))], [*b.schema.names, *names])

    return map_batches(df, run, ", ".join(old + [added]), rows)
