"""Text files of any size, block by block: numbered lines and digests.

Spark reads a large file in blocks, each in its own task. Lines come out of a block in order, so a line's
number is the number of lines in the blocks before it and its own place; no task sees a whole file
unless it is one block. A digest has to take its bytes in turn: blocks are packed into chunks in parallel, and one task a
file hashes the chunks as a stream, never holding more than a batch of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.session import materialize

#: Bytes of a chunk; a hand-over between the engine and a worker has 10,000 of them at most.
CHUNK = 1 << 14
_BOM = b"\xef\xbb\xbf"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, block, id, value``: ``id`` rises within a block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, line`` of text files, lines numbered from 0; a carriage return before a line end is dropped.

    Only one row per block is added up; lines are stored once, so that their ids hold.
    """
    rows = materialize(_raw(spark, path).drop("size"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("pos"),
                                                       F.regexp_replace("value", "\r$", "").alias("line"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, length, sha256`` of files of any size, over their bytes (compressed text: over what it unpacks to).

    The line reader leaves out line ends and a byte order mark; the file's size tells which there were. Files
    without any byte but line ends are hashed as well; empty files have no row. A single line has to fit a row.
    """
    def pack(batches):
        key, parts, held, seq = None, [], 0, 0
        for batch in batches:
            files, sizes, blocks, ids, values = (batch.column(c) for c in ("file", "size", "block", "id", "value"))
            for i in range(len(batch)):
                now = (files[i].as_py(), sizes[i].as_py(), blocks[i].as_py())
                if key is not None and (now != key or held >= CHUNK):
                    yield chunk(key, seq, parts)
                    seq, parts, held = seq + 1 if now == key else 0, [], 0
                key = now
                value = values[i].as_py()
                parts.append(value)
                held += len(value) + 1
        if key is not None:
            yield chunk(key, seq, parts)

    def chunk(key, seq, parts):
        return pa.RecordBatch.from_pydict({"file": [key[0]], "size": pa.array([key[1]], pa.int64()), "block": pa.array([key[2]], pa.int64()),
                                           "seq": pa.array([seq], pa.int64()), "chunk": pa.array([b"\n".join(parts)], pa.binary())})

    def digest(batches):
        at, state, length, size = None, None, 0, 0
        for batch in batches:
            done = []
            for file, total, data in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), batch.column("chunk")):
                data = data.as_py()
                if file != at:
                    if at is not None:
                        done.append((at, size, finish(state, length, size)))
                    at, state, length, size = file, Stream(), -1, total
                state.add(data, first=length < 0)
                length += len(data) + 1
            yield rows(done)
        if at is not None:
            yield rows([(at, size, finish(state, length, size))])

    def rows(done):
        return pa.RecordBatch.from_pydict({"file": pa.array([d[0] for d in done], pa.string()), "length": pa.array([d[1] for d in done], pa.int64()),
                                           "sha256": pa.array([d[2] for d in done], pa.string())})

    packed = _raw(spark, path).withColumn("value", F.col("value").cast("binary")).mapInArrow(
        pack, "file string, size long, block long, seq long, chunk binary")
    ordered = packed.repartition("file").sortWithinPartitions("file", "block", "seq")
    return ordered.mapInArrow(digest, "file string, length long, sha256 string")


class Stream:
    """SHA-256 of lines joined by line ends, with and without a byte order mark before them."""

    def __init__(self):
        self.states = [hashlib.sha256(), hashlib.sha256(_BOM)]

    def add(self, data: bytes, first: bool) -> None:
        for state in self.states:
            if not first:
                state.update(b"\n")
            state.update(data)


def finish(stream: Stream, length: int, size: int) -> str:
    """The digest of a file of ``size`` bytes whose lines and inner line ends are ``length`` bytes."""
    marked, ended = divmod(size - length, len(_BOM))
    state = stream.states[1 if marked == 1 else 0]
    if ended == 1:
        state.update(b"\n")
    return state.hexdigest()
