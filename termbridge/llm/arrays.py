"""Texts of Arrow batches as flat byte arrays: words and their 64-bit hashes without Python objects.

Words are the runs of `[^\\x20\\x09-\\x0D]`, with A-Z lower-cased. Two words are taken as one
when their hashes agree; among a billion different words that is expected for 0.03 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """The first ``n`` pseudo-random 64-bit numbers of a seed."""
    return mix(np.arange(n, dtype=U64) + U64(seed) * U64(0x100000001B3))


BYTE_VALUES = numbers(256, 1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """The batch in slices of about ``limit`` text bytes, whole rows each, so that work arrays stay small."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first byte of every word, in order."""
    inside = ~WHITE[data]
    if not inside.any():
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    letters = LOWER[data[inside]]
    at = (np.cumsum(inside) - 1)[starts]  # where each word starts among the letters
    lengths = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    weights = numbers(int(lengths.max()), 2)
    hashes = np.add.reduceat(BYTE_VALUES[letters] * weights[place], at)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return mix(hashes ^ (lengths.astype(U64) * U64(0xD6E8FEB86659FD93))), rows, starts


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of a row, repeats included, and the n_rows + 1 offsets.

    A row with fewer words has one shingle of all its words, a row without words none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    begins = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(made)])
    factors = numbers(width, 3)
    first = np.repeat(begins[:-1], made) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], made))
    size = np.repeat(np.minimum(counts, width), made)
    padded = np.append(hashes, np.zeros(width, U64))
    total = size.astype(U64) * U64(0xA24BAED4963EE407)
    for k in range(width):
        total += np.where(k < size, padded[first + k], U64(0)) * factors[k]
    return mix(total), offsets


def column_of(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(values.view(np.int64))


def binaries(parts) -> pa.Array:
    return pa.array(parts, pa.binary())
