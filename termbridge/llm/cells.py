"""Comparing the rows of a cell pair by pair inside tasks, with large cells split.

A cell is a group of rows that a hash function puts together. Cells of one row are left out.
A cell of more than ``block`` rows is cut into blocks by row id, and every pair of blocks is
compared by itself, so no task sees more than two blocks of a cell at a time. No pair is
written out here: tasks count links or return a forest of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

col = F.col


def split_cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows (cell, id) of cells with two rows or more, with part_a, part_b and side.

    Each row comes once per other block of its cell: once in a small cell.
    """
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    n_blocks = F.ceil(col("n_rows") / block)
    met = rows.join(sizes, "cell").withColumns(
        {"n_blocks": n_blocks.cast("int"), "side": F.pmod(F.xxhash64("id"), n_blocks).cast("int")}
    )
    other = F.explode(F.sequence(F.lit(0), col("n_blocks") - 1)).alias("other")
    return met.select("cell", "id", "side", other).select(
        "cell",
        F.least("side", "other").alias("part_a"),
        F.greatest("side", "other").alias("part_b"),
        "side",
        "id",
    )


def in_cells(rows: DataFrame, task: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``task`` to stretches of whole cells.

    The task gets a table, the end of each row's cell and the row's cell number in the stretch.
    """
    keys = ["cell", "part_a", "part_b"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            starts = _starts(table)
            cut = int(starts[-1])
            if cut:
                yield task(*_whole(table.slice(0, cut), starts[:-1]))
            kept = table.slice(cut).combine_chunks()
        if kept is not None:
            yield task(*_whole(kept, _starts(kept)))

    def _starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def _whole(table: pa.Table, starts: np.ndarray):
        sizes = np.diff(np.append(starts, table.num_rows))
        return table, np.repeat(starts + sizes, sizes), np.repeat(np.arange(len(starts)), sizes)

    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    return placed.mapInArrow(stretches, schema)


def pair_steps(ends: np.ndarray, crossing: np.ndarray, side: np.ndarray, most: int = 65536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within cells, a bounded number at a time, near ones first.

    ``crossing`` marks rows of cells in which only rows of different sides are compared.
    """
    left = np.arange(len(ends))
    step = 1
    while True:
        left = left[left + step < ends[left]]
        if not len(left):
            return
        for k in range(0, len(left), most):
            i = left[k : k + most]
            j = i + step
            wanted = ~crossing[i] | (side[i] != side[j])
            if not wanted.all():
                i, j = i[wanted], j[wanted]
            if len(i):
                yield i, j
        step += 1


class Forest:
    """Joins positions and says which pairs were needed for it."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def needed(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                break
            self.root = up
        apart = self.root[i] != self.root[j]
        taken = []
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                taken.append((a, b))
        return taken

    def find(self, a: int) -> int:
        while self.root[a] != a:
            self.root[a] = self.root[self.root[a]]
            a = int(self.root[a])
        return a
