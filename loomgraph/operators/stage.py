"""Tables that several later steps read, written once."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_made: dict[tuple, dict[str, object]] = {}


def stage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder the session names; only a local session that names none (tests) gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return df.checkpoint()


def once(spark: SparkSession, path: str, name: str, make: Callable[[], T]) -> T:
    """``make()``, staged tables made from the files at ``path``, and the same tables again while neither session nor files change.

    Tables of one state of one input are kept at a time; another input, or a changed file, lets them go.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listStatus(place)
    state = (spark.sparkContext.applicationId, path, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    if state not in _made:
        _made.clear()
        _made[state] = {}
    if name not in _made[state]:
        _made[state][name] = make()
    return _made[state][name]
