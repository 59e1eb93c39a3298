"""Near-duplicate texts by min-max hashing.

A text's set holds its distinct runs of ``WIDTH`` words (A-Z lower-cased, words are
`[^\\x20\\x09-\\x0D]+`); a shorter text is one run of all its words; without words the set is
empty and links with nothing. Under each of 80 permutations both the smallest and the largest
hash are kept, so 160 signature values cost 80 hash evaluations per run. Five values form a
band (never both ends of one permutation); two texts of similarity 0.75 miss all 32 bands with
probability 0.0002. Texts that share a band are compared by signature, and those that may reach
the threshold by their full sets. Only verified links count.

Work: one pass over the texts; then a row of signatures per distinct set and shared band; then
the texts that may have a link. Within a band's group only a forest of likely links is tested
first, so a large group of copies costs one test per row, not one per pair. What is still apart
after that is compared by full sets within the bands' groups, and only links are written.
Equal sets are one class from the start.
"""

from __future__ import annotations

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
WIDTH = 5
PERMUTATIONS = 80
BAND = 5  # values of a band
BLOCK = 4096  # rows of a cell whose signatures are compared in one piece
EXACT_BLOCK = 256  # rows of a cell whose full sets are
SURE, LIKELY = 0.82, 0.6  # estimates: tested first, tested at all (0.75 is 4.4 deviations above)
NUMERATOR, DENOMINATOR = 3, 4  # a link: intersection / union >= 3 / 4
SKETCH = "doc_id long, digest long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors, shifts = arrays.numbers(PERMUTATIONS, 11) | arrays.U64(1), arrays.numbers(PERMUTATIONS, 12)
    n_bands = 2 * PERMUTATIONS // BAND
    places = arrays.numbers(BAND, 13)
    for batch in batches:
        for part in arrays.pieces(batch, "text"):
            hashes, offsets = arrays.shingles(*arrays.words(*arrays.flat(part.column("text")))[:2], part.num_rows, WIDTH)
            full = np.flatnonzero(np.diff(offsets))
            sizes = np.zeros(part.num_rows, np.int64)
            sums = np.zeros((2, part.num_rows), arrays.U64)
            for k in full:
                own = np.unique(hashes[offsets[k] : offsets[k + 1]])
                sizes[k] = len(own)
                sums[0, k] = own.sum()
                sums[1, k] = arrays.mix(own).sum()
            values = np.zeros((len(full), 2 * PERMUTATIONS), arrays.U64)
            if len(full):
                at = offsets[full]  # rows without runs take no place
                for p in range(PERMUTATIONS):
                    moved = hashes * factors[p] + shifts[p]
                    values[:, p] = np.minimum.reduceat(moved, at)
                    values[:, PERMUTATIONS + p] = np.maximum.reduceat(moved, at)
            bytes_ = (arrays.mix(values) & arrays.U64(255)).astype(np.uint8)
            keys = (arrays.mix(values).reshape(len(full), n_bands, BAND) * places).sum(axis=2)
            keys = arrays.mix(keys + np.arange(n_bands, dtype=arrays.U64))
            signature, bands = [None] * part.num_rows, [None] * part.num_rows
            for n, k in enumerate(full.tolist()):
                signature[k] = bytes_[n].tobytes()
                bands[k] = keys[n].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("digest"),
                    pa.array(sizes),
                    arrays.column_of(sums[0]),
                    arrays.column_of(sums[1]),
                    arrays.binaries(signature),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "n_shingles", "set_a", "set_b", "signature", "bands"],
            )


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _estimates(signatures: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Estimated similarity, 0 where the sizes alone forbid a link."""
    agree = (signatures[i] == signatures[j]).mean(axis=1)
    allowed = DENOMINATOR * np.minimum(sizes[i], sizes[j]) >= NUMERATOR * np.maximum(sizes[i], sizes[j])
    return np.where(allowed, (agree * 256 - 1) / 255, 0.0)


def _pairs_of(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = ids[np.array([x for x, _ in found], np.int64)]
    b = ids[np.array([y for _, y in found], np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _likely_forest(table: pa.Table, ends: np.ndarray, _cells: np.ndarray) -> pa.RecordBatch:
    """Per cell, pairs that would tie together all rows that may be linked."""
    signatures, sizes = _signatures(table), table.column("n_shingles").to_numpy()
    crossing = table.column("part_a").to_numpy() != table.column("part_b").to_numpy()
    side, forest, found = table.column("side").to_numpy(), Forest(table.num_rows), []
    for least in (SURE, LIKELY):
        for i, j in pair_steps(ends, crossing, side):
            apart = forest.root[i] != forest.root[j]
            i, j = i[apart], j[apart]
            likely = _estimates(signatures, sizes, i, j) >= least
            found += forest.needed(i[likely], j[likely])
    return _pairs_of(table.column("id").to_numpy(), found)


def _likely_rows(table: pa.Table, ends: np.ndarray, _cells: np.ndarray) -> pa.RecordBatch:
    """Per cell, the rows with a likely partner in another component."""
    signatures, sizes = _signatures(table), table.column("n_shingles").to_numpy()
    crossing = table.column("part_a").to_numpy() != table.column("part_b").to_numpy()
    side, group, found = table.column("side").to_numpy(), table.column("component").to_numpy(), np.zeros(table.num_rows, bool)
    for i, j in pair_steps(ends, crossing, side):
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
        likely = _estimates(signatures, sizes, i, j) >= LIKELY
        found[i[likely]] = found[j[likely]] = True
    cells, ids = table.column("cell").to_numpy()[found], table.column("id").to_numpy()[found]
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(ids)], ["cell", "id"])


def _links_between(table: pa.Table, ends: np.ndarray, _cells: np.ndarray) -> pa.RecordBatch:
    """Per cell, links by the full sets that tie different components; a pair is tested in its first common band."""
    signatures, sizes = _signatures(table), table.column("n_shingles").to_numpy()
    crossing = table.column("part_a").to_numpy() != table.column("part_b").to_numpy()
    side, ids, cells = (table.column(c).to_numpy() for c in ("side", "id", "cell"))
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    sets = []
    for part in table.select(["text"]).combine_chunks().to_batches():
        for piece in arrays.pieces(part, "text"):
            sets += _sets(piece)
    _, group = np.unique(table.column("component").to_numpy(), return_inverse=True)
    same, found = Forest(int(group.max()) + 1), []
    for i, j in pair_steps(ends, crossing, side):
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
        likely = _estimates(signatures, sizes, i, j) >= LIKELY
        i, j = i[likely], j[likely]
        shared = bands[i] == bands[j]
        first = bands[i, shared.argmax(axis=1)] == cells[i]
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            if same.find(group[x]) != same.find(group[y]) and _reach(sets[x], sets[y]):
                same.needed(group[[x]], group[[y]])
                found.append((x, y))
    return _pairs_of(ids, found)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sorted set of each text."""
    hashes, offsets = arrays.shingles(*arrays.words(*arrays.flat(batch.column("text")))[:2], batch.num_rows, WIDTH)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def _reach(known: np.ndarray, own: np.ndarray) -> bool:
    """Whether two sets are linked."""
    at = np.searchsorted(known, own)
    same = int((known[np.minimum(at, len(known) - 1)] == own).sum())
    return DENOMINATOR * same >= NUMERATOR * (len(known) + len(own) - same)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (a, salt, own first): the pairs whose full sets reach the threshold."""
    centre, known = None, None
    for batch in batches:
        for part in arrays.pieces(batch, "text"):
            a, salt, b = (part.column(c).to_pylist() for c in ("a", "salt", "b"))
            kept = []
            for k, own in enumerate(_sets(part)):
                if b[k] is None:
                    centre, known = (a[k], salt[k]), own
                    continue
                if centre != (a[k], salt[k]):
                    raise ValueError("a pair came without the text of its first document")
                if _reach(known, own):
                    kept.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], ["a", "b"]
            )


def verify(pairs: DataFrame, texts: DataFrame, group: int = 256) -> DataFrame:
    """The pairs (a, b) whose full sets of runs reach the threshold.

    The first text of many pairs is sent once per ``group`` pairs, so no task gets all of them.
    ``texts`` has one row (id, text) per id.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("n"))
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), "n").cast("int").alias("salt"), "b")
    own = counts.select("a", F.explode(F.sequence(F.lit(0), col("n") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    wanted = members.union(own).withColumn("id", F.coalesce("b", "a"))
    rows = wanted.join(texts, "id").select("a", "salt", "b", "text")
    placed = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return placed.mapInArrow(_linked, "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Null or empty texts have n_shingles 0 and are their own component. Rows that share a doc_id
    are linked by their own texts each. Rows without doc_id link with nothing: component_id null,
    kept true. An empty table gives no rows. Other columns are not read.
    """
    return _judged(documents, doc_id, text, block).drop("digest")


def without_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that ``near_duplicates`` keeps, each by its own decision.

    A decision depends on nothing but doc_id and text, so rows that share both share it.
    """
    dropped = _judged(documents, doc_id, text, BLOCK).where("NOT kept").select("doc_id", "digest").distinct()
    same = (col(f"given.{doc_id}").cast("long") == col("dropped.doc_id")) & (
        F.xxhash64(col(f"given.{text}").cast("string")) == col("dropped.digest")
    )
    return documents.alias("given").join(dropped.alias("dropped"), same, "left_anti")


def _judged(documents: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    """The result of ``near_duplicates`` with the digest of each row's text."""
    given = documents.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    given = given.withColumn("digest", F.xxhash64("text"))
    sketches = cut_lineage(given.mapInArrow(_sketches, SKETCH))
    keys = ["set_a", "set_b", "n_shingles"]
    filled = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"))
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    first = filled.join(classes, [*keys, "doc_id"]).dropDuplicates(["id"])
    first = cut_lineage(first.select("id", "doc_id", "digest", "n_shingles", "signature", "bands"))

    banded = first.select(F.explode("bands").alias("cell"), "id").distinct()
    parts = split_cells(banded, block)
    members = cut_lineage(parts.join(first.select("id", "n_shingles", "signature"), "id"))
    met = members.select("id").distinct().join(first.select("id", "doc_id", "digest"), "id")
    texts = cut_lineage(given.join(met, ["doc_id", "digest"]).select("id", "text").dropDuplicates(["id"]))

    likely = cut_lineage(in_cells(members, _likely_forest, "a long, b long").distinct())
    links = cut_lineage(verify(likely, texts))
    found = connected_components(links)
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    between = cut_lineage(in_cells(placed, _likely_rows, "cell long, id long").distinct())
    if between.take(1):
        known = first.select("id", "n_shingles", "signature", "bands").join(placed.select("id", "component").distinct(), "id")
        rows = split_cells(between, EXACT_BLOCK).join(known, "id").join(texts, "id")
        more = cut_lineage(in_cells(rows, _links_between, "a long, b long").distinct())
        found = connected_components(links.union(more)) if more.take(1) else found

    grouped = classes.join(found.withColumnRenamed("node", "id"), "id", "left")
    grouped = cut_lineage(grouped.withColumn("component", F.coalesce("component", "id")))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = grouped.join(least, "component").select(*keys, "component_id")
    done = sketches.select("doc_id", "digest", *keys).join(of_class, keys, "left")
    linked = F.when((col("n_shingles") > 0) & col("doc_id").isNotNull(), col("component_id"))
    done = done.select("doc_id", "digest", "n_shingles", F.coalesce(linked, "doc_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(col("doc_id") == col("component_id"), F.lit(True)))
