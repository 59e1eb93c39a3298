"""Pairs of token sets that overlap enough, block against block inside a task; only such pairs leave it.

A set is its token numbers, the rarest first. Two sets that reach the threshold share a token among the first
ones of each, as many as the threshold asks for: those of one block are an index, those of the other look
into it. Lengths and the places of a shared token rule out most pairs, marks of 512 bits most of the rest
(bits that differ are tokens that differ), and what is left is counted token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK_WORDS = 8  # of 64 bits
MET_PER_STEP = 1 << 20  # sets that meet under a token, looked at together
FLAGS_PER_STEP = 1 << 23  # pairs of a group of sets and a block
TOKENS_PER_STEP = 1 << 21  # that are marked or counted together
FOUND = "a binary, b binary, both int, total int"


class _Limits:
    """What the similarity ``t`` asks of sets by their sizes, below ``span``."""

    def __init__(self, t: Fraction, span: int):
        p, q = t.numerator, t.denominator
        self.span = span
        self.need = np.array([-(-n * p // q) for n in range(span)])  # tokens shared with any partner
        self.most = np.array([min(n * q // p, span - 1) for n in range(span)])  # tokens of a partner
        self.least = np.array([-(-n * p // (p + q)) for n in range(2 * span)])  # tokens shared, by the sum of sizes


class _Block:
    """Set k has the tokens ``flat[start[k] : start[k] + size[k]]``."""

    def __init__(self, table: pa.Table):
        tokens = table["tokens"].combine_chunks()
        self.ids = table["id"].combine_chunks()
        self.flat = tokens.flatten().to_numpy()
        self.size = pc.list_value_length(tokens).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.marks = self._marked()

    def _marked(self) -> np.ndarray:
        marks = np.zeros(len(self.size) * MARK_WORDS, np.uint64)
        owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        shift = np.uint64(64 - (64 * MARK_WORDS - 1).bit_length())
        for at in range(0, len(self.flat), TOKENS_PER_STEP):
            part = slice(at, at + TOKENS_PER_STEP)
            bit = (self.flat[part].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift
            word = owner[part].astype(np.int64) * MARK_WORDS + (bit >> np.uint64(6)).astype(np.int64)
            np.bitwise_or.at(marks, word, np.uint64(1) << (bit & np.uint64(63)))
        return marks.reshape(-1, MARK_WORDS)

    def first(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Set, token and number of tokens from there on, for the first ``count`` tokens of every set."""
        owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.flat[self.start[owner] + at].astype(np.int64), (self.size[owner] - at).astype(np.int32)

    def tokens_of(self, rows: np.ndarray) -> np.ndarray:
        """The tokens of chosen sets under their place in ``rows``, in one sorted array if those of a set are."""
        size = self.size[rows]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.start[rows], size)
        return (np.repeat(np.arange(len(rows)), size) << 32) + self.flat[at]


def _candidates(asking: _Block, index: _Block, limits: _Limits, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of ``asking`` and as long or longer ones of ``index`` that lengths and places allow, each once.

    With ``longer``, those of ``index`` have more tokens.
    """
    posted, token, after = index.first(index.size - limits.need[index.size] + 1)
    key = token * limits.span + index.size[posted]
    order = np.argsort(key, kind="stable")
    key, posted, after = key[order], posted[order], after[order]
    posted_size = index.size[posted].astype(np.int32)
    owner, token, left = asking.first(asking.size - limits.least[2 * asking.size] + 1)
    size = asking.size[owner]
    low = np.searchsorted(key, token * limits.span + size + longer)
    high = np.searchsorted(key, token * limits.span + limits.most[size], side="right")
    total = np.append(0, np.cumsum(np.maximum(high - low, 0)))
    size, width = size.astype(np.int32), len(index.size)
    group = max(1, FLAGS_PER_STEP // width)
    for begin in range(0, len(asking.size), group):
        at, end = np.searchsorted(owner, [begin, begin + group])
        if total[at] == total[end]:
            continue
        flags = np.zeros(group * width, bool)
        while at < end:
            to = min(end, max(at + 1, np.searchsorted(total, total[at] + MET_PER_STEP, side="right") - 1))
            met = total[at + 1 : to + 1] - total[at:to]
            mine = np.repeat(np.arange(at, to), met)
            theirs = np.arange(len(mine)) + np.repeat(low[at:to] - (total[at:to] - total[at]), met)
            enough = np.minimum(left[mine], after[theirs]) >= limits.least[size[mine] + posted_size[theirs]]
            mine, theirs = mine[enough], theirs[enough]
            flags[(owner[mine].astype(np.int64) - begin) * width + posted[theirs]] = True
            at = to
        a, b = np.divmod(np.flatnonzero(flags), width)
        yield a + begin, b


def _checked(x: _Block, y: _Block, a: np.ndarray, b: np.ndarray, limits: _Limits) -> Iterator[tuple[np.ndarray, ...]]:
    """Those of the pairs that share enough, with the number of shared tokens and of all tokens of both."""
    close = []
    for at in range(0, len(a), TOKENS_PER_STEP // MARK_WORDS):
        i, j = (v[at : at + TOKENS_PER_STEP // MARK_WORDS] for v in (a, b))
        total = x.size[i] + y.size[j]
        differ = np.bitwise_count(x.marks[i] ^ y.marks[j]).sum(1, dtype=np.int64)
        close.append(at + np.flatnonzero((total - differ) // 2 >= limits.least[total]))
    close = np.concatenate(close) if close else np.zeros(0, np.int64)
    a, b = a[close], b[close]
    total = x.size[a] + y.size[b]
    step = np.cumsum(total) // TOKENS_PER_STEP
    for rows in np.split(np.arange(len(a)), np.flatnonzero(np.diff(step)) + 1) if len(a) else ():
        ours, theirs = x.tokens_of(a[rows]), y.tokens_of(b[rows])
        place = np.minimum(np.searchsorted(ours, theirs), len(ours) - 1)
        both = np.bincount(theirs[ours[place] == theirs] >> 32, minlength=len(rows))
        kept = both >= limits.least[total[rows]]
        yield a[rows][kept], b[rows][kept], both[kept], total[rows][kept]


def _met(x: _Block, y: _Block | None, limits: _Limits) -> Iterator[pa.RecordBatch]:
    """Pairs of a set of ``x`` and one of ``y``, or of two sets of ``x``."""
    runs = [(x, x, False)] if y is None else [(x, y, False), (y, x, True)]
    for asking, index, longer in runs:
        for a, b in _candidates(asking, index, limits, longer):
            if y is None:
                once = (asking.size[a] < index.size[b]) | (a < b)
                a, b = a[once], b[once]
            for i, j, both, total in _checked(asking, index, a, b, limits):
                if len(i):
                    ids = asking.ids.take(pa.array(i)), index.ids.take(pa.array(j))
                    counts = pa.array(both.astype(np.int32)), pa.array(total.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*(ids[::-1] if longer else ids), *counts], ["a", "b", "both", "total"])


def overlapping(t: Fraction, alone: frozenset[int]):
    """For ``mapInArrow`` over rows sorted by ``cell``: ``part`` 0 and 1 of a cell meet, or those of a cell in ``alone`` each other.

    Rows have cell, part, id and tokens.
    """

    def of(cell: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        part = table["part"].to_numpy()
        x = _Block(table.filter(pa.array(part == 0)))
        y = None if cell in alone else _Block(table.filter(pa.array(part == 1)))
        if len(x.size) and (y is None or len(y.size)):
            span = 1 + max(int(b.size.max()) for b in (x, y) if b is not None)
            yield from _met(x, y, _Limits(t, span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            begins = np.append(0, np.flatnonzero(np.diff(cells)) + 1) if len(cells) else []
            for begin, end in zip(begins, [*begins[1:], len(cells)], strict=True):
                if cells[begin] != cell and held:
                    yield from of(cell, held)
                    held = []
                cell = int(cells[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from of(cell, held)

    return run
