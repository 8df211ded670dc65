"""Token-id files of length-delimited binary records, with a separate offset index.

A record is ``length (u64) | masked crc of the length (u32) | payload | masked crc of the payload (u32)``,
little-endian. The payload is ``doc_id (i64) | is_null (u8) | token ids (u16 or u32)``. A checksum is CRC-32,
rotated right by 15 bits plus a constant, so that the checksum of bytes which hold checksums stays sound.

Each task writes one shard under a name of its own attempt, so a second attempt or a lost executor never
spoils a shard; only shards named in the index exist for readers. The index has a row per record
(shard, place, doc_id, byte offset and length, tokens) and serves shuffled reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import work_dir
from loomgraph.llm.encoding import END_ID, default_vocabulary, encoder

#: Fixed value: the constant of the masked-checksum framing.
MASK = 0xA282EAD8
HEAD, TAIL, FRONT = "<QI", "<I", "<qB"
HEAD_SIZE, TAIL_SIZE, FRONT_SIZE = 12, 4, 9

INDEX = "shard string, part int, place long, doc_id long, offset long, length long, n_tokens long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(TAIL, masked(length)) + payload + struct.pack(TAIL, masked(payload))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a shard in order; raises on a damaged or cut record."""
    while head := stream.read(HEAD_SIZE):
        if len(head) < HEAD_SIZE:
            raise ValueError("a record's head is cut off")
        length, check = struct.unpack(HEAD, head)
        if masked(head[:8]) != check:
            raise ValueError("a record's length is damaged")
        body = stream.read(length + TAIL_SIZE)
        if len(body) < length + TAIL_SIZE or masked(body[:length]) != struct.unpack(TAIL, body[length:])[0]:
            raise ValueError("a record is damaged")
        yield body[:length]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, width: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order to shards under ``path``; return the offset index.

    Null texts are empty, null ids sort first, rows of one id follow their text; more columns are ignored.
    ``width`` is the bytes of an id in a file. Texts are dealt by doc_id range before they are encoded,
    so nothing is encoded twice and a task holds one batch at a time.
    """
    vocabulary, spark = vocabulary or default_vocabulary(), docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    dealt = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        out, at, place, tokens = None, 0, 0, encoder(vocabulary)
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    rows = []
                    ids = part.column(0).to_pylist()
                    for doc_id, blob in zip(ids, tokens.encode(part.column(1).to_pylist()), strict=True):
                        blob += END_ID.to_bytes(4, "little")
                        n = len(blob) // 4
                        if width == 2:
                            wide = np.frombuffer(blob, "<u4")
                            if int(wide.max()) > 0xFFFF:
                                raise ValueError("an id is too large for two bytes; use width=4")
                            blob = wide.astype("<u2").tobytes()
                        record = frame(struct.pack(FRONT, doc_id or 0, doc_id is None) + blob)
                        out = out or system.open_output_stream(f"{folder}/{name}")
                        out.write(record)
                        rows.append((name, task.partitionId(), place, doc_id, at, len(record), n))
                        at, place = at + len(record), place + 1
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "part", "place", "doc_id", "offset", "length", "n_tokens"])
        finally:
            if out:
                out.close()

    dealt.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_token_files(index: DataFrame, path: str, width: int = 2) -> DataFrame:
    """Stream every shard of ``index`` and return doc_id, start, n_tokens, ids_crc32 from the files' bytes.

    ``start`` is the ids in all records before it. A task reads one shard; the shards' bases are a running
    sum over one row per shard, never over documents.
    """
    shards = index.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    bases = shards.select("part", "shard", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = []
                with system.open_input_stream(f"{folder}/{shard}", buffer_size=1 << 20) as stream:
                    for payload in unframe(stream):
                        doc_id, null = struct.unpack_from(FRONT, payload)
                        ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=FRONT_SIZE)
                        rows.append((None if null else doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    many = max(index.sparkSession.sparkContext.defaultParallelism, 1) * 4
    return bases.repartition(many, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(index: DataFrame, path: str, width: int = 2) -> DataFrame:
    """Read records by the offset index, in whatever order and selection ``index`` has: doc_id, ids."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        files: dict[str, object] = {}
        for batch in batches:
            got = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard not in files:
                    files.clear()
                    files[shard] = system.open_input_file(f"{folder}/{shard}")
                record = files[shard].read_at(length, offset)
                payload = next(unframe(pa.BufferReader(record)))
                doc_id, null = struct.unpack_from(FRONT, payload)
                got.append((None if null else doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=FRONT_SIZE).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return index.mapInArrow(read, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32 (see the two functions above)."""
    path = work_dir(docs.sparkSession, "records")
    return read_token_files(write_token_files(docs, path, vocabulary), path)
