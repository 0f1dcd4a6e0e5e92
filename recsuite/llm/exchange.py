"""Two-way exchange between chunks of documents and buckets of keys.

Many corpus-wide steps ask one question per distinct key of a document set (the ids of a word, the corpus count of a
word pair, whether a passage occurs elsewhere).  Here every task cuts its documents into chunks of bounded size, sends
each distinct key of a chunk once to the key's bucket, and gets one answer per key back; the chunk, which travelled in
compressed form, is then finished with its answers.  A key in a third of all documents costs one entry per chunk, so no
bucket is hot, and nothing is ever gathered per key beyond one entry per chunk.

    send(blocks)              -> [(bucket, payload)]    keys of one chunk, each bucket once
    answer([payload, ...])    -> [payload, ...]         one answer per chunk that wrote to the bucket, in order
    finish(blocks, answers)   -> rows                   blocks: RecordBatches of the chunk; answers: {bucket: payload}

``state`` may hold rows of a bucket (columns bucket, kind, src, state), which ``answer`` then gets as a second argument, a
table (None for a bucket without one).

The input has to give the same rows in the same order when a task runs again, as a table read from files does: a chunk
carries a checksum of its texts, and a chunk whose answers are missing stops the job instead of giving wrong rows.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .blocks import BLOCK_BYTES, row_blocks, text_bytes, text_column

CHUNK_BYTES = 12 << 20
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))


def to_bytes(batches: Iterable[pa.RecordBatch]) -> bytes:
    batches = list(batches)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=_ZSTD) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def from_bytes(raw) -> list[pa.RecordBatch]:
    with pa.ipc.open_stream(raw) as src:
        return list(src)


def columns(**arrays) -> bytes:
    """One batch of named arrays as compressed bytes."""
    return to_bytes([pa.RecordBatch.from_arrays([pa.array(a) if not isinstance(a, pa.Array) else a
                                                 for a in arrays.values()], names=list(arrays))])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; the bytes of equal weight stand together, so unused high bytes cost nothing."""
    parts = []
    for a in arrays:
        parts.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
                     if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(bytes(raw))
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<2sq", data, at)
        dtype = np.dtype(kind.decode())
        at += struct.calcsize("<2sq")
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def chunks(batches: Iterator[pa.RecordBatch], text_col: str, limit: int) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """(chunk id, blocks) with at most ``limit`` bytes of text a chunk; one row at least."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    number, held, size, check = 0, [], 0, 0
    for batch in batches:
        for block in row_blocks(batch, text_col, min(BLOCK_BYTES, limit)):
            buf, off = text_bytes(text_column(block, text_col))
            if held and size + buf.size > limit:
                yield f"{part}-{number}-{check}", held
                number, held, size, check = number + 1, [], 0, 0
            held.append(block)
            size += buf.size
            check = zlib.crc32(off, zlib.crc32(buf, check))
    if held:
        yield f"{part}-{number}-{check}", held


def buckets_of(docs: DataFrame) -> int:
    """Twice the shuffle partitions: small buckets, more than one per task."""
    return 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of the steps that are over: it does so when the driver collects the last reference
    to them, which a small driver may not do for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def send_chunks(docs: DataFrame, text_col: str, send: Callable, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Only the way to the buckets: (bucket, chunk, payload) of what ``send`` yields."""

    def send_keys(batches):
        for chunk, blocks in chunks(batches, text_col, chunk_bytes):
            for bucket, payload in send(blocks):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk]),
                                                  pa.array([payload], pa.binary())], names=["bucket", "chunk", "payload"])

    return docs.mapInArrow(send_keys, "bucket int, chunk string, payload binary")


def round_trip(docs: DataFrame, text_col: str, send: Callable, answer: Callable, finish: Callable, schema: str,
               chunk_bytes: int = CHUNK_BYTES, state: DataFrame | None = None) -> DataFrame:
    """Run the exchange over ``docs``; ``finish`` yields RecordBatches or Tables of ``schema``."""

    def send_bodies(batches):
        for chunk, blocks in chunks(batches, text_col, chunk_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([to_bytes(blocks)], pa.binary())],
                                             names=["chunk", "body"])

    def answer_bucket(rows: pa.Table, known: pa.Table | None = None) -> pa.Table:
        rows = rows.sort_by("chunk")
        payloads = [p.as_buffer() for p in rows["payload"]]
        if not payloads:
            replies = []
        elif known is None:
            replies = answer(payloads)
        else:
            replies = answer(payloads, known if known.num_rows else None)
        return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "reply": pa.array(replies, pa.binary())})

    def finish_chunk(replies: pa.Table, bodies: pa.Table) -> pa.Table:
        if bodies.num_rows != 1:
            raise RuntimeError("the documents did not come in the same order twice; write them to a table first")
        blocks = from_bytes(bodies["body"][0].as_buffer())
        got = {b.as_py(): r.as_buffer() for b, r in zip(replies["bucket"], replies["reply"])}
        out = [pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x for x in finish(blocks, got)]
        return pa.concat_tables(out)

    keys = send_chunks(docs, text_col, send, chunk_bytes)
    reply = "chunk string, bucket int, reply binary"
    if state is None:
        replies = keys.groupBy("bucket").applyInArrow(lambda rows: answer_bucket(rows), reply)
    else:
        replies = (keys.groupBy("bucket").cogroup(state.select("bucket", "kind", "src", "state").groupBy("bucket"))
                   .applyInArrow(lambda rows, known: answer_bucket(rows, known), reply))
    bodies = docs.mapInArrow(send_bodies, "chunk string, body binary")
    return replies.groupBy("chunk").cogroup(bodies.groupBy("chunk")).applyInArrow(finish_chunk, schema)
