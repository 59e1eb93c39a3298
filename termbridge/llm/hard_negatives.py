"""Hard negatives by a secondary sort of scores.

Scores are exact integer inner products. Rows lie in blocks, and every block of anchors visits every
block of rows. A pair that can matter becomes a packed key (anchor, descending score, positives first,
id), so that one shuffle by anchor with a sort by key (``repartitionAndSortWithinPartitions``) lets an
iterator read each anchor from its best score down: a positive opens a window at its score, a negative
goes to the open windows that still take it, and nothing of an anchor is held but its windows.

Before that shuffle a block keeps only what the iterator could use of it: in the first pass its own first
positives of an anchor, in the second pass, when the positives are known, its own first negatives of
every window. Both cuts keep all rows of the answer, whatever the blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.llm import blocks
from termbridge.session import cut_lineage, shuffle_width

col = F.col
ROWS = 65536  # rows of a block at most; fewer where that gives every core several blocks
LEAST_ROWS = 1024
ANCHORS = 1024  # anchors of a block
CELLS = 1 << 22  # scores that a task holds at once
LONGEST = float(1 << 62)  # bound of a vector's squared length, so that every score is a long
SIGN = np.uint64(1 << 63)
KEY = ">QQQBQ"  # anchor id, anchor row, descending score, negative or not, id
KEY_BYTES = struct.calcsize(KEY)
LOW = 1 << 63

BLOCK = "slot int, kind int, dim int, n int, ids binary, labels binary, numbers binary, vectors binary, windows binary"
NAMES = [c.split(" ")[0] for c in BLOCK.split(", ")]


def _packed(x: np.ndarray) -> bytes:
    """Signed integers, as their least one and the distances from it."""
    base = int(x.min()) if x.size else 0
    return struct.pack("<q", base) + blocks.pack(x.reshape(-1).astype(np.int64).view(np.uint64) - np.uint64(base & (2**64 - 1)))


def _unpacked(data: bytes) -> np.ndarray:
    base = struct.unpack("<q", data[:8])[0]
    return (blocks.unpack(data[8:]).view(np.uint64) + np.uint64(base & (2**64 - 1))).view(np.int64)


def quantised(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors floor(scale * x), a group per dimension; unusable rows are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    for dim in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == dim)
        x = values[offsets[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(x).all(axis=1)
            q = np.floor(scale * x)
            good &= (q * q).sum(axis=1) < LONGEST
        yield rows[good], q[good].astype(np.int64)


def _row_blocks(scale: float):
    """One block of rows per task and dimension, sorted by id, numbered by the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, labels, anchor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "anchor"))
            for rows, q in quantised(batch.column("vector"), scale):
                if len(rows):
                    held.setdefault(q.shape[1], []).append((ids[rows], labels[rows], anchor[rows], q))
        slot, made = TaskContext.get().partitionId(), 0
        for dim, parts in held.items():
            ids, labels, anchor, q = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(ids, kind="stable")
            ids, labels, anchor, q = ids[order], labels[order], anchor[order], q[order]
            numbers = (slot << 32) + made + np.arange(len(ids))
            made += len(ids)
            whole = [slot, 0, dim, len(ids), _packed(ids), _packed(labels), _packed(numbers), _packed(q), b""]
            yield _batch([whole])
            at = np.flatnonzero(anchor)
            for k in range(0, len(at), ANCHORS):
                part = at[k : k + ANCHORS]
                yield _batch([[slot, 1, dim, len(part), *(_packed(x[part]) for x in (ids, labels, numbers, q)), b""]])

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], NAMES)


def _keys(anchor_ids, anchor_numbers, scores, kind: int, ids) -> pa.RecordBatch:
    """Packed keys as one column; a smaller key comes first."""
    made = np.empty((len(ids), KEY_BYTES), np.uint8)
    for at, x in ((0, anchor_ids), (8, anchor_numbers), (25, ids)):
        made[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ SIGN).astype(">u8")[:, None].view(np.uint8)
    made[:, 16:24] = (~(scores.astype(np.int64).view(np.uint64) ^ SIGN)).astype(">u8")[:, None].view(np.uint8)
    made[:, 24] = kind
    offsets = pa.py_buffer((np.arange(len(ids) + 1) * KEY_BYTES).astype(np.int32))
    column = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(made)])
    return pa.RecordBatch.from_arrays([column], ["key"])


def unpack_key(key: bytes) -> tuple[int, int, int, int, int]:
    """anchor id, anchor row, score, kind, id"""
    anchor, number, score, kind, row = struct.unpack(KEY, key)
    return anchor - LOW, number - LOW, (score ^ (2**64 - 1)) - LOW, kind, row - LOW


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where no partial sum can pass 2^53, else in 64-bit integers."""
    longest = [np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0)) for x in (a, b)]
    if longest[0] * longest[1] < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class _Block:
    def __init__(self, row: dict):
        self.n, self.dim = row["n"], row["dim"]
        self.ids, self.labels, self.numbers = (_unpacked(row[c]) for c in ("ids", "labels", "numbers"))
        self.vectors = _unpacked(row["vectors"]).reshape(self.n, self.dim) if self.dim else np.zeros((self.n, 0), np.int64)
        self.windows = _unpacked(row["windows"]).reshape(self.n, -1, 2) if row["windows"] else None


def _meetings(cells: int, meet):
    """Blocks sorted by (slot, dimension, kind): every block of anchors meets the slot's block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in NAMES}
                if (row["slot"], row["dim"]) != place:
                    place, held = (row["slot"], row["dim"]), []
                block = _Block(row)
                if row["kind"] == 0:
                    held.append(block)
                    continue
                for rows in held:
                    yield from meet(block, rows, max(1, cells // max(1, rows.n)))

    return run


def _first_positives(count: int):
    """The first ``count`` same-label rows of a block for every anchor."""

    def meet(anchors: _Block, rows: _Block, step: int) -> Iterator[pa.RecordBatch]:
        for label in np.unique(anchors.labels):
            mine, there = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
            if not len(there):
                continue
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                scores = _products(anchors.vectors[part], rows.vectors[there])
                other = anchors.numbers[part][:, None] != rows.numbers[there][None, :]
                scores = np.where(other, scores, np.iinfo(np.int64).min)
                take = min(count, len(there))
                least = np.partition(scores, len(there) - take, axis=1)[:, len(there) - take]
                a, r = np.nonzero((scores >= least[:, None]) & other)
                order = np.lexsort((r, -scores[a, r], a))  # r is in order of ids
                a, r = a[order], r[order]
                first = np.arange(len(a)) - np.searchsorted(a, a) < count
                a, r = a[first], r[first]
                yield _keys(anchors.ids[part[a]], anchors.numbers[part[a]], scores[a, r], 0, rows.ids[there[r]])

    return meet


def _first_negatives(count: int):
    """For every window of an anchor, (score, least score) pairs, the first ``count`` other-label rows of a block in it."""

    def meet(anchors: _Block, rows: _Block, step: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, anchors.n, step):
            windows = anchors.windows[k : k + step]
            scores = _products(anchors.vectors[k : k + step], rows.vectors)
            inside = (scores <= windows[:, :, 0].max(axis=1)[:, None]) & (scores >= windows[:, :, 1].min(axis=1)[:, None])
            a, r = np.nonzero(inside & (anchors.labels[k : k + step, None] != rows.labels[None, :]))
            falling = -scores[a, r]
            order = np.lexsort((r, falling, a))
            a, r, falling = a[order], r[order], falling[order]
            ends = np.searchsorted(a, np.arange(len(windows) + 1))
            used = np.zeros(len(a), bool)
            for n in np.unique(a):
                mine = falling[ends[n] : ends[n + 1]]
                for top, least in windows[n]:
                    begin = np.searchsorted(mine, -top, "left")
                    end = min(begin + count, np.searchsorted(mine, -least, "right"))
                    used[ends[n] + begin : ends[n] + max(begin, end)] = True
            a, r, falling = a[used], r[used], falling[used]
            if len(a):
                yield _keys(anchors.ids[k + a], anchors.numbers[k + a], -falling, 1, rows.ids[r])

    return meet


def _with_windows(count: int, low: int, high: int):
    """Anchors in blocks, with the windows of their positives: the score and the least score a negative may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for dim in {r["dim"] for r in rows}:
                group = [r for r in rows if r["dim"] == dim]
                for k in range(0, len(group), ANCHORS):
                    part = group[k : k + ANCHORS]
                    windows = np.zeros((len(part), count, 2), np.int64)
                    for n, r in enumerate(part):
                        found = [(s, -((-low * s) // high)) for s in r["scores"] if s >= 0]  # Python integers cannot overflow
                        windows[n] = (found + [found[0]] * count)[:count]
                    vectors = np.concatenate([_unpacked(r["vector"]) for r in part]) if dim else np.zeros(0, np.int64)
                    columns = (np.array([r[c] for r in part], np.int64) for c in ("id", "label", "number"))
                    yield _batch([[0, 1, dim, len(part), *(_packed(x) for x in columns), _packed(vectors), _packed(windows)]])

    return run


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            block = _Block({c: batch.column(c)[k].as_py() for c in NAMES})
            vectors = [_packed(v) for v in block.vectors]
            data = [pa.array(x, pa.int64()) for x in (block.numbers, block.ids, block.labels)]
            yield pa.RecordBatch.from_arrays(
                [*data, pa.array([block.dim] * block.n, pa.int32()), pa.array(vectors, pa.binary())], ["number", "id", "label", "dim", "vector"]
            )


def _meet(rows: DataFrame, anchors: DataFrame, slots: int, cells: int, meet) -> DataFrame:
    """Every block of anchors sent once to every block of rows."""
    sent = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).select(*NAMES)
    met = rows.select(*NAMES).unionAll(sent).repartitionByRange(slots, "slot").sortWithinPartitions("slot", "dim", "kind")
    return met.mapInArrow(_meetings(cells, meet), "key binary")


def _by_anchor(key: bytes) -> int:
    """All keys of an anchor go to one task; consecutive rows to different ones."""
    return int.from_bytes(key[8:16], "big") * 0x9E3779B97F4A7C15 % 2**64 >> 32


def _sorted_keys(keys: DataFrame):
    """The secondary sort: tasks by anchor, within them the order of the packed keys."""
    pairs = keys.rdd.map(lambda r: (bytes(r[0]), None))
    return pairs.repartitionAndSortWithinPartitions(shuffle_width(keys), _by_anchor)


def first_of_anchors(count: int):
    """The first ``count`` keys of every anchor: (anchor row, anchor id, scores, ids)."""

    def run(records):
        anchor, found = None, []

        def done():
            head = unpack_key(found[0])
            return head[1], head[0], [unpack_key(k)[2] for k in found], [unpack_key(k)[4] for k in found]

        for key, _ in records:
            if key[:16] != anchor:
                if found:
                    yield done()
                anchor, found = key[:16], []
            if len(found) < count:
                found.append(key)
        if found:
            yield done()

    return run


def windows(count: int, low: int, high: int):
    """Keys in order: a positive opens a window, a negative goes to the windows that still take it."""

    def run(records):
        anchor, opened = None, []
        for key, _ in records:
            if key[:16] != anchor:
                anchor, opened = key[:16], []
            anchor_id, _, score, kind, row = unpack_key(key)
            if kind == 0:
                opened.append([row, score, 0])
                continue
            for window in opened:
                if window[2] < count and low * window[1] <= high * score:
                    window[2] += 1
                    yield anchor_id, window[0], window[2], row, window[1], score

    return run


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    row_id: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    scale: float = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block_rows: int | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the integer inner product; higher scores come first,
    ties by smaller id. An anchor (a row where ``anchor`` holds) has as its positives its first ``positives`` other rows of the same label; for each, the
    first ``negatives`` rows of another label with low * positive_score <= high * negative_score and
    negative_score <= positive_score come back, numbered from 1.

    Rows without id, label or vector, or with a null or non-finite component, take no part; nor do vectors whose
    quantised squared length reaches 2^62, whose scores no long could hold. Vectors of different length are not
    compared; empty ones score 0. Repeated rows are rows of their own: an anchor's copy is another row.
    Rows that tie in score and id give the same columns. Other columns are not read; an empty table gives no rows.
    ``block_rows`` and ``cells`` (memory of a task) change the plan, not the rows.
    """
    if not 0 <= low < high:
        raise ValueError("low must be at least 0 and below high")
    spark = rows.sparkSession
    given = rows.select(
        col(row_id).cast("long").alias("id"),
        (col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.coalesce(anchor.cast("boolean"), F.lit(False)).alias("anchor"),
        col(vector).alias("vector"),
    ).where("id is not null and label is not null and vector is not null")
    total = given.count()
    size = block_rows or max(LEAST_ROWS, min(ROWS, total // (4 * spark.sparkContext.defaultParallelism) + 1))
    slots = max(1, -(-total // size))
    made = cut_lineage(given.repartition(slots).mapInArrow(_row_blocks(scale), BLOCK))
    blocks_of_rows, anchors = made.where("kind = 0"), made.where("kind = 1")

    pairs = _meet(blocks_of_rows, anchors, slots, cells, _first_positives(positives))
    found = _sorted_keys(pairs).mapPartitions(first_of_anchors(positives))
    found = spark.createDataFrame(found, "number long, anchor_id long, scores array<long>, ids array<long>", verifySchema=False)
    found = cut_lineage(found.where("scores[0] >= 0"))  # a negative score lies in no window of its own

    alone = anchors.mapInArrow(_anchor_rows, "number long, id long, label long, dim int, vector binary")
    opened = alone.join(found.select("number", "scores"), "number").mapInArrow(_with_windows(positives, low, high), BLOCK)
    keys = _meet(blocks_of_rows, cut_lineage(opened), slots, cells, _first_negatives(negatives))
    heads = found.select("number", "anchor_id", F.explode(F.arrays_zip("scores", "ids")).alias("at"))
    heads = heads.select("number", "anchor_id", col("at.scores").alias("score"), col("at.ids").alias("row"))
    keys = cut_lineage(keys.unionAll(heads.mapInArrow(_positive_keys, "key binary")))
    out = _sorted_keys(keys).mapPartitions(windows(negatives, low, high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(out, schema, verifySchema=False)


def _positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, number, score, row = (batch.column(c).to_numpy() for c in ("anchor_id", "number", "score", "row"))
        yield _keys(anchor, number, score, 0, row)
