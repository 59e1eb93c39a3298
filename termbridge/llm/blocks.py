"""Packed integers and buckets for tables whose rows stand for a block of documents.

Operators that need something of every word (its ids, its count) form blocks of about
``BLOCK_BYTES`` of text inside tasks. A block knows its different words once; only those meet the
words of other blocks, in buckets by hash, so a word in every document costs a row per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from termbridge.llm import arrays
from termbridge.session import scratch_path

BLOCK_BYTES = 8 << 20


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane, compressed."""
    x = np.ascontiguousarray(numbers, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, : data[0]] = planes.T
    return x.reshape(-1).view(np.int64)


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a task in blocks of about ``limit`` text bytes, whole rows each."""
    held, size = [], 0
    for batch in batches:
        for part in arrays.pieces(batch, "text", limit // 4):
            held.append(part)
            size += part.column("text").nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def placed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of its keys: a join on them leaves it where it is."""
    name = f"blocks_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, *keys).option("path", scratch_path(df.sparkSession, name))
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def block_number(n: int) -> int:
    """A number for the n-th block of this task."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + n


def ranked(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes renumbered so that frequent ones are small, and the old code of each new one."""
    order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
    new = np.empty(n, np.int64)
    new[order] = np.arange(n)
    return new[codes], order
