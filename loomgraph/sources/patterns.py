"""Labelled blocks of a BEGIN/END text, read in byte ranges by a Python data source, with every bad line accounted for.

A range's task takes the blocks that begin in it, and reads on past its end until the last of them is over; what stands
before a file's first block goes to the range at its start. A block hangs on its own lines only, so any split gives the same rows.
A block's rows are those between its BEGIN and its END, the next BEGIN, or the end of the file.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomgraph.functions import scalars as S
from loomgraph.operators.numbering import numbered

BEGIN = re.compile(r"BEGIN LAUNDERING ATTEMPT\s*-\s*([A-Z][A-Z-]*)\s*(?::\s*(.*))?$")
END = re.compile(r"END LAUNDERING ATTEMPT\s*-\s*([A-Z][A-Z-]*)\s*$")
WIDTH = 11
LINES = "file string, block long, place long, kind string, typology string, description string, fields array<string>, ts timestamp, amount double, amount_src double, label int"
#: What a line or block can be beside a row: each is an anomaly but for ``begin``.
ANOMALIES = ("empty_block", "nested_begin", "unmatched_end", "unclosed_at_eof", "orphan_row", "malformed_row", "typology_mismatch")


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class PatternSource(DataSource):
    """Options: path (a file or folder), split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "patterns"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PatternReader(self.options["path"], int(self.options.get("split", 1 << 26)))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class PatternReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, place = _open(self.path)
        info = system.get_file_info(place)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, at, min(at + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, max(f.size, 1), self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as stream:
            yield from blocks(stream, partition.file, partition.start, partition.end)


def lines(stream, start: int) -> Iterator[tuple[int, bytes]]:
    """Whole lines from the first that begins at ``start`` or later, with their places."""
    at = max(start - 1, 0)
    stream.seek(at)
    rest = b""
    skip = start > 0
    while True:
        more = stream.read(1 << 20)
        rest += more
        found = rest.split(b"\n")
        rest = found.pop()
        for line in found:
            if skip:
                skip = False  # the line that the byte before ``start`` is in
            else:
                yield at, line
            at += len(line) + 1
        if not more:
            if rest and not skip:
                yield at, rest
            return


def blocks(stream, file: str, start: int, end: int) -> Iterator[tuple]:
    """The lines of the blocks that begin in [``start``, ``end``), as rows of ``LINES``."""
    block, typology, words, rows = (-1, None, "", 0) if start == 0 else (None, None, "", 0)

    def row(at: int, kind: str, fields: list[str] | None = None, *values) -> tuple:
        return (file, block, at, kind, typology, words, fields, *(values or (None,) * 4))

    def close(at: int) -> list[tuple]:
        return [] if rows else [row(at, "empty_block")]

    for at, raw in lines(stream, start):
        line = raw.decode("utf-8", "replace").rstrip("\r")
        if not line.strip():
            continue
        if m := BEGIN.match(line):
            if typology is not None:
                yield row(at, "nested_begin")
                yield from close(at)
            if at >= end:
                return
            block, typology, words, rows = at, m[1], (m[2] or "").strip(), 0
            yield row(at, "begin")
        elif block is None:
            continue  # of a block that begins in an earlier range
        elif m := END.match(line):
            if typology is None:
                yield row(at, "unmatched_end")
            else:
                if m[1] != typology:
                    yield row(at, "typology_mismatch")
                yield from close(at)
                typology, words, rows = None, "", 0
        elif typology is None:
            yield row(at, "orphan_row")
        else:
            fields = next(csv.reader([line]), [])
            try:
                if len(fields) != WIDTH:
                    raise ValueError(len(fields))
                values = (datetime.strptime(fields[0].strip(), "%Y/%m/%d %H:%M"), float(fields[5]), float(fields[7]), int(fields[10]))
            except ValueError:
                yield row(at, "malformed_row", fields)
            else:
                rows += 1
                yield row(at, "row", fields, *values)
    if block is not None and typology is not None:
        yield row(end, "unclosed_at_eof")
        yield from close(end)


def read_lines(spark: SparkSession, path: str, split: int = 1 << 26) -> DataFrame:
    """Every line that counts, with its block (the place where it begins, -1 before the first) and kind."""
    spark.dataSource.register(PatternSource)
    return spark.read.format("patterns").option("path", path).option("split", split).load()


def rings(read: DataFrame) -> DataFrame:
    """Labelled edges of ``read_lines``: ring (numbered from 0 in order of files and blocks, blocks without a good row left out), typology, description, place and the edge's columns."""
    rows = read.filter("kind = 'row'")
    number = numbered(rows.select("file", "block").distinct(), ["file", "block"], "ring")
    f = F.col("fields")
    return rows.join(number, ["file", "block"]).select("ring", "typology", "description", "place", S.account_key(f[1], f[2]).alias("src"), S.account_key(f[3], f[4]).alias("dst"), "ts", "amount", S.amount_key(f[5]).alias("amount_key"), F.trim(f[6]).alias("currency"), "amount_src", F.trim(f[8]).alias("currency_src"), F.trim(f[9]).alias("channel"), "label")


def anomalies(read: DataFrame) -> DataFrame:
    """How often each anomaly occurs: kind, n. None, if the files are clean."""
    return read.filter(F.col("kind").isin(*ANOMALIES)).groupBy("kind").agg(F.count("*").alias("n"))


def strict_rings(read: DataFrame) -> DataFrame:
    """``rings``, or an error that names the anomalies: for labels that have to be complete."""
    if found := {r.kind: r.n for r in anomalies(read).collect()}:  # a row per kind
        raise ValueError(f"patterns hold anomalies: {found}")
    return rings(read)


def described(edges: DataFrame) -> DataFrame:
    """Per typology of ``rings``: n_rings, n_edges, accounts_min, accounts_med, accounts_max, edges_med, trivial (two accounts or fewer)."""
    ends = edges.select("ring", "typology", F.explode(F.array("src", "dst")).alias("account")).groupBy("ring", "typology").agg(F.count_distinct("account").alias("accounts"))
    per = ends.join(edges.groupBy("ring").agg(F.count("*").alias("edges")), "ring")
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c}) * -1")  # noqa: E731  of an even number, the higher middle one
    return per.groupBy("typology").agg(F.count("*").alias("n_rings"), F.sum("edges").alias("n_edges"), F.min("accounts").alias("accounts_min"), upper("accounts").alias("accounts_med"), F.max("accounts").alias("accounts_max"), upper("edges").alias("edges_med"), F.count(F.when(F.col("accounts") <= 2, 1)).alias("trivial"))
