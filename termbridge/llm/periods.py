"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring
word extends and that is long enough. Distances are searched at dyadic scales: at scale b those from b to
2b - 1 (from 1 at the smallest). The words are cut into aligned blocks of b; a run of at least three
periods of that size holds a whole block whose next occurrence lies one period on. The sums of squared
differences between a block and the words at every distance of the scale come from one exact integer
number-theoretic transform: a sum of zero is an occurrence. Each distance found seeds an extension over
the words themselves, which settles the run's ends; of equal stretches the smallest distance is the period.

Words enter the transform as small numbers (word number modulo m, with m so small that a sum stays
below the modulus and is exact); two words may share one, so a seed counts only if the words agree too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.llm import arrays
from termbridge.session import spread

LEAST = 24  # words of a run
PERIODS = 3  # periods of a run
SMALLEST = 8  # words of the blocks at the smallest scale
LARGEST = 1 << 19  # words of a block; scales beyond it look at several stretches of distances
PRIME = 7340033  # 7 * 2^20 + 1: sums of 64 products of residues below twice it are exact in doubles
ROOT = 3
WIDTH = 64  # size of a transform done as one matrix product
CELLS = 1 << 18  # numbers that one transform works on at a time


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues between -PRIME and 2 * PRIME, in place: the quotient can be off by one."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


def _powers(root: int, count: int) -> np.ndarray:
    out = np.ones(count, np.int64)
    done = 1
    while done < count:  # doubling: the next half is this one times root^done
        out[done : 2 * done] = out[: min(done, count - done)] * pow(root, done, PRIME) % PRIME
        done *= 2
    return out


class Transform:
    """The number-theoretic transform of columns of length n, in an order of its own.

    Large ones split into WIDTH (or fewer) rows and shorter transforms, each level a matrix product.
    """

    def __init__(self, n: int):
        self.n = n
        root = pow(ROOT, (PRIME - 1) // n, PRIME)
        table = _powers(root, n)
        bits = n.bit_length() - 1
        self.first = n if n <= WIDTH else 1 << min(6, (bits + 1) // 2)
        self.rest = n // self.first
        step = table[:: self.rest]
        turn = np.outer(np.arange(self.first), np.arange(self.first)) % self.first
        self.forward_matrix = step[turn].astype(float)
        self.inverse_matrix = (step[-turn % self.first] * pow(self.first, -1, PRIME) % PRIME).astype(float)
        self.below = None
        if self.rest > 1:
            self.below = Transform(self.rest)
            at = np.outer(np.arange(self.first), np.arange(self.rest))
            self.twist = table[at % n][:, :, None].astype(float)
            self.untwist = table[-at % n][:, :, None].astype(float)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """``x``: (groups, rows, columns); of n rows, the second half may be left out if it is zero."""
        groups, given, columns = x.shape
        used = given // self.rest
        y = _mod(np.matmul(self.forward_matrix[:, :used], x.reshape(groups, used, self.rest * columns)))
        if self.below is None:
            return y
        y = _mod(y.reshape(groups, self.first, self.rest, columns) * self.twist)
        y = self.below.forward(y.reshape(groups * self.first, self.rest, columns))
        return y.reshape(groups, self.n, columns)

    def inverse(self, y: np.ndarray, rows: int | None = None) -> np.ndarray:
        """Back to the first ``rows`` of the columns."""
        groups, _, columns = y.shape
        wanted = self.first if rows is None else rows // self.rest
        if self.below is not None:
            y = self.below.inverse(y.reshape(groups * self.first, self.rest, columns))
            y = _mod(y.reshape(groups, self.first, self.rest, columns) * self.untwist)
        x = np.matmul(self.inverse_matrix[:wanted], y.reshape(groups, self.first, self.rest * columns))
        return _mod(x).reshape(groups, wanted * self.rest, columns)

    def _of_unit(self, place: int) -> np.ndarray:
        unit = np.zeros((1, self.n, 1))
        unit[0, place, 0] = 1
        return self.forward(unit)[0, :, 0].astype(np.int64) % PRIME


@lru_cache(maxsize=None)
def _plan(n: int) -> tuple[Transform, np.ndarray, np.ndarray]:
    """The transform, where the opposite frequency of each one lies, and what a shift by n/2 does to it."""
    transform = Transform(n)
    ahead, back = transform._of_unit(1), transform._of_unit(n - 1)
    opposite = np.empty(n, np.int64)
    opposite[np.argsort(back)] = np.argsort(ahead)
    half = transform._of_unit(n // 2)
    return transform, opposite, np.where(half == 1, 1.0, -1.0)[:, None]


def occurrences(letters: np.ndarray, block: int, starts: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (k, e): the block that begins at starts[k] occurs again ``offset`` + e words on, 0 <= e < block.

    ``letters`` are small numbers, ``starts`` and ``offset`` multiples of ``block``. Words beyond the end count as 0.
    """
    transform, opposite, shift = _plan(2 * block)
    numbers, ahead = starts // block, offset // block
    found = []
    step = max(1, CELLS // (2 * block))
    for k in range(0, len(numbers), step):
        mine = numbers[k : k + step]
        needed = np.unique(np.concatenate([mine, mine + ahead, mine + ahead + 1]))
        size = int(needed[-1] + 1) * block
        at = needed[:, None] * block + np.arange(block)
        if size > len(letters):
            cells = np.where(at < len(letters), letters[np.minimum(at, len(letters) - 1)], 0)
        else:
            cells = letters[at]
        squares = np.cumsum(cells * cells, axis=1)
        spectrum = transform.forward(np.ascontiguousarray(cells.T, dtype=float)[None])[0]
        own, one, two = (np.searchsorted(needed, mine + d) for d in (0, ahead, ahead + 1))
        window = spectrum[:, one] + shift * spectrum[:, two]
        product = _mod(spectrum[opposite][:, own] * window)
        crossed = transform.inverse(product[None], block)[0]
        whole = squares[:, -1]
        before = np.concatenate([np.zeros((len(needed), 1), squares.dtype), squares[:, :-1]], axis=1)
        stretch = (whole[one][:, None] - before[one] + before[two]).T  # squares of the block words that begin e words on
        total = _mod(whole[own][None, :] + stretch - 2.0 * crossed)
        e, n = np.nonzero((total == 0) | (np.abs(total) == PRIME))
        found.append((k + n, e))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _agree(x: np.ndarray, at: int, distance: int, end: int) -> int:
    """The first place from ``at`` on whose word differs from the one ``distance`` on, or where that one is at ``end``."""
    size, last = 64, end - distance
    while at < last:
        to = min(last, at + size)
        off = np.flatnonzero(x[at:to] != x[at + distance : to + distance])
        if len(off):
            return at + int(off[0])
        at, size = to, min(2 * size, 1 << 20)
    return last


def _agree_back(x: np.ndarray, at: int, distance: int, begin: int) -> int:
    """The first place of the agreeing words that end before ``at``."""
    size = 64
    while at > begin:
        to = max(begin, at - size)
        off = np.flatnonzero(x[to:at] != x[to + distance : at + distance])
        if len(off):
            return to + int(off[-1]) + 1
        at, size = to, min(2 * size, 1 << 20)
    return begin


def find_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int, int]]:
    """(row, start, length, period) of every run of the rows, sorted; ``words`` numbers the words of all rows.

    A run has at least ``least`` words (24 or more) and ``periods`` periods (3 or more). Row k holds words
    offsets[k] to offsets[k + 1].
    """
    if least < 3 * SMALLEST or periods < 3:
        raise ValueError("runs of fewer than 24 words or 3 periods are not found")
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(len(words), np.int64)  # the furthest end of the known runs that begin here
    longest = int(np.diff(offsets).max(initial=0))
    scales, low = [(SMALLEST, 0)], SMALLEST  # words of a block, least distance
    while low <= longest // periods:
        scales.append((min(low, LARGEST), low))
        low *= 2
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for block, low in scales:
        starts = np.arange(0, len(words) - block, block)
        row = row_of[starts]
        end = offsets[row + 1]
        long_enough = end - offsets[row] >= max(least, periods * max(low, 1))
        m = max(2, min(1 << 16, isqrt((PRIME - 1) // block)))
        letters = words % m
        runs = []
        for offset in range(low, max(2 * low, block), block):
            some = np.flatnonzero(long_enough & (starts + max(offset, 1) + block <= end))
            if not len(some):
                continue
            n, e = occurrences(letters, block, starts[some], offset)
            at, distance, stop = starts[some[n]], offset + e, end[some[n]]
            # Inside a known run (its period is at most a block) the distance is a multiple of the known period.
            covered = np.maximum.accumulate(reach)
            good = (distance > 0) & (at + distance + block <= stop) & (at + distance + block > covered[at])
            order = np.lexsort((at[good], distance[good]))
            begin = offsets[row[some[n[good]]]]
            last = (0, 0)  # distance and end of the last stretch
            for s, d, first, to in zip(*(x[order].tolist() for x in (at[good], distance[good], begin, stop[good]))):
                if last[0] == d and s + d + block <= last[1]:
                    continue
                right = _agree(words, s, d, to) + d
                if right < s + d + block:
                    continue  # different words with the same letters
                left = _agree_back(words, s, d, first)
                last = (d, right)
                if right - left >= max(least, periods * d):
                    runs.append((left, right, d))
        for left, right, d in runs:
            found[left, right] = min(d, found.get((left, right), d))
            if d <= LARGEST:
                reach[left] = max(reach[left], right)
    out = []
    for (left, right), d in found.items():
        k = int(row_of[left])
        out.append((k, left - int(offsets[k]), right - left, d))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _periodic(keep: list[str], least: int, periods: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.pieces(batch, "text", limit):
                index: dict[bytes, int] = {}
                split = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]  # at [\x20\x09-\x0D]+
                offsets = np.cumsum([0] + [len(w) for w in split])
                numbers = np.fromiter((index.setdefault(w, len(index)) for row in split for w in row), np.int64, int(offsets[-1]))
                runs: list[list] = [[] for _ in split]
                for k, start, length, period in find_runs(numbers, offsets, least, periods):
                    runs[k].append({"start": start, "length": length, "period": period})
                collapsed = []
                for row, mine in zip(split, runs):
                    if mine:
                        stays = np.ones(len(row), bool)
                        for r in mine:
                            stays[r["start"] + r["period"] : r["start"] + r["length"]] = False
                        row = [w for w, s in zip(row, stays.tolist()) if s]
                    collapsed.append(b" ".join(row))
                made = [pa.array(np.diff(offsets), pa.int64()), pa.array(runs, RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(
    documents: DataFrame, text: str = "text", keep: str = "doc_id", least: int = LEAST, periods: int = PERIODS, piece_bytes: int = 2 << 20
) -> DataFrame:
    """Per row: the ``keep`` column, n_words, runs (start, length and period in words, by start, then period) and
    collapsed: the text without the words of each run after its first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. Rows stay rows: repeated ids and null ids have
    results of their own. A null or empty text has no words, no runs and an empty collapsed text. An
    empty table gives no rows. Other columns are not read. Nothing is shuffled but inputs with fewer splits than
    cores; a task holds the words of ``piece_bytes`` of text, or of one text where that is longer.
    """
    given = spread(documents.select(F.col(keep).alias("__key"), F.col(text).cast("string").alias("text")))
    kind = given.schema["__key"].dataType.simpleString()
    schema = f"__key {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return given.mapInArrow(_periodic(["__key"], least, periods, piece_bytes), schema).withColumnRenamed("__key", keep)
