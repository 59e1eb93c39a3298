"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many random directions. Along one direction a vector collides with
those inside a window centred on it; a pair is verified when it collides along enough of the 64
directions that are counted. A window on one direction alone holds a fixed share of all
pairs, so counting starts inside sorted cells: ``depth`` further projections, cut at a width of
1.5, must agree, in one of ``tables`` such tables. Depth and number of tables follow from the
number of vectors (cells stay small) and the recall at cosine 0.95 exactly (``miss``); closer
pairs are missed far less often.

Verified means cosine >= 0.95 in double precision. Equal vectors are one class from the start.
A pair that meets in several tables counts in the first. Pairs are counted inside tasks, and
only a forest of the links of each cell is written; cells of more than ``block`` vectors are split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.llm import arrays
from termbridge.llm.cells import Forest, in_cells, pair_steps, split_cells
from termbridge.llm.components import connected_components
from termbridge.session import cut_lineage

col = F.col
COSINE = 0.95
CELL_WIDTH = 1.5  # in units in which a unit vector's projection has deviation 1
COUNTED = 64  # directions whose collisions are counted
MISS = 0.002  # share of pairs at the threshold that no table brings together
BLOCK = 4096


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def same_slot(width: float, distance: float) -> float:
    """Probability that two vectors at a distance share a randomly shifted slot of a projection."""
    r = width / distance
    return 1 - 2 * _phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(depth, tables) for n vectors: about 32 unrelated vectors a cell, ``miss`` at the threshold."""
    near, far = same_slot(CELL_WIDTH, math.sqrt(2 - 2 * cosine)), same_slot(CELL_WIDTH, math.sqrt(2))
    depth = max(2, math.ceil(math.log(max(n, 1) / 32) / -math.log(far))) if n > 32 else 2
    return depth, max(1, math.ceil(math.log(miss) / math.log(1 - near**depth)))


def least_count(cosine: float = COSINE, miss: float = MISS / 10) -> int:
    """Largest count that a pair at the threshold reaches except with probability ``miss``.

    The window reaches one distance to either side, which 68 % of such pairs keep.
    """
    p, below, count = 1 - 2 * _phi(-1.0), 0.0, 0
    while True:
        below += math.comb(COUNTED, count) * p**count * (1 - p) ** (COUNTED - count)
        if below > miss:
            return count
        count += 1


def _directions(size: int, columns: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, columns))


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(depth: int, tables: int):
    """Per vector its cell in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = arrays.numbers(depth, 21)
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vector").to_pylist()], np.int64)
            keys = np.zeros((batch.num_rows, tables), arrays.U64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _unit([batch.column("vector")[k].as_py() for k in rows.tolist()])
                shift = np.random.default_rng([5, int(size)]).uniform(0, CELL_WIDTH, depth * tables)
                slots = np.floor((x @ _directions(int(size), depth * tables, 3) + shift) / CELL_WIDTH).astype(np.int64)
                slots = arrays.mix(slots.view(arrays.U64)).reshape(len(rows), tables, depth)
                number = np.arange(tables, dtype=arrays.U64) + arrays.U64(int(size) << 20)
                keys[rows] = arrays.mix((slots * mixers).sum(axis=2) + arrays.mix(number))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], ["id", "cells"]
            )

    return run


def _count_links(cosine: float):
    reach, enough = math.sqrt(2 - 2 * cosine), least_count(cosine)

    def task(table: pa.Table, ends: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        """Rows (a, b, n): n partners of a found here, or with b a link of the cell's forest."""
        n = table.num_rows
        size = len(table.column("vector")[0])  # of one length within a cell, not always within a stretch
        lengths = np.diff(table.column("vector").combine_chunks().offsets.to_numpy()) if n else np.zeros(0)
        vectors = table.column("vector").to_pylist()
        ids, weight = table.column("id").to_numpy(), table.column("size").to_numpy()
        keys = np.array(table.column("cells").to_pylist(), np.int64)
        number = table.column("number").to_numpy()
        side = table.column("side").to_numpy()
        crossing = table.column("part_a").to_numpy() != table.column("part_b").to_numpy()
        links, forest, tied = np.zeros(n, np.int64), Forest(n), []
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            x = _unit([vectors[k] for k in rows.tolist()])
            slots = (x @ _directions(int(size), COUNTED, 7)).astype(np.float32)
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            own_ends = np.searchsorted(rows, ends[rows])
            for i, j in pair_steps(own_ends, crossing[rows], side[rows], 16384):
                met = (np.abs(slots[i] - slots[j]) <= reach).sum(axis=1) >= enough
                i, j = i[met], j[met]
                close = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = rows[i[close]], rows[j[close]]
                earlier = (keys[i] == keys[j]) & (np.arange(keys.shape[1]) < number[i][:, None])
                fresh = ~earlier.any(axis=1)
                i, j = i[fresh], j[fresh]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                tied += forest.needed(i, j)
        some = np.flatnonzero(links)
        a = np.concatenate([ids[some], ids[np.array([x for x, _ in tied], np.int64)]])
        b = [None] * len(some) + ids[np.array([y for _, y in tied], np.int64)].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b, pa.int64()), pa.array(np.concatenate([links[some], np.zeros(len(tied), np.int64)]))], ["a", "b", "n"]
        )

    return task


def linked_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, miss: float = MISS, block: int = BLOCK
) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
    do vectors of different lengths. Equal vectors are linked. Rows that share a vec_id are
    rows of their own. A row without vec_id links with nothing: component_id null, kept true.
    An empty table gives no rows. Other columns are not read.
    """
    given = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = given.where(usable)
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    depth, tables = plan(classes.count(), cosine, miss)
    keyed = cut_lineage(classes.select("id", "vector").mapInArrow(_keys(depth, tables), "id long, cells array<long>"))

    met = split_cells(keyed.select(F.posexplode("cells").alias("number", "cell"), "id"), block)
    payload = classes.select("id", "size", "vector").join(keyed, "id")
    number = F.array_position("cells", col("cell")) - 1
    rows = met.join(payload, "id").withColumn("number", number.cast("int"))
    found = cut_lineage(in_cells(rows, _count_links(cosine), "a long, b long, n long"))
    reached = connected_components(found.where("b IS NOT NULL"))
    counted = found.where("b IS NULL").groupBy(col("a").alias("id")).agg(F.sum("n").alias("n"))

    grouped = classes.join(counted, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    grouped = cut_lineage(grouped.withColumn("component", F.coalesce("component", "id")))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("n", F.lit(0)) + col("size") - 1
    of_class = grouped.join(least, "component").select("vector", n_links.alias("n_links"), "component_id")
    done = given.withColumn("usable", usable).join(of_class.withColumn("usable", F.lit(True)), ["vector", "usable"], "left")
    done = done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return done.withColumn("kept", F.coalesce(col("vec_id") == col("component_id"), F.lit(True)))
