"""Exact top-k search by inner product, lookups, and the retrieval strategies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termbridge.functions.similarity import token_set
from termbridge.functions.text import query_text, query_variants
from termbridge.operators.skew import first_rows, number_rows
from termbridge.operators.vectors import embed_text
from termbridge.session import cut_lineage, shuffle_width

BLOCK_BYTES = 8 << 20  # of the universe that a task holds at a time
PACKED_BYTES = 1 << 20  # of the universe that travel as one row
PART_BYTES = 32 << 20  # of the universe that a task sees in all
HELD_BYTES = 64 << 20  # of queries and their best rows that a task holds
NOTED_ROWS = 1 << 18  # that wait to be ranked
SCORES_PER_STEP = 1 << 22


# --------------------------------------------------------------------------
# Block kernel: dense products inside a task, only the best k rows leave it.


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal-length vectors as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) and flat.size % len(column):
        raise ValueError("vectors must have the same length")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _exact_scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Products of chosen pairs, summed the same way whatever the block shapes are."""
    out = np.empty(len(rows))
    step = max(1, SCORES_PER_STEP // max(1, q.shape[1]))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        out[part] = np.einsum("ij,ij->i", q[rows[part]], x[cols[part]])
    return out


class _Offered:
    """The universe, or a block of it, in code order and ready for products."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("code", "ascending")]))
        self.codes = table["code"].combine_chunks()
        self.x = _matrix(table["vec"])
        self.single = self.x.astype(np.float32)
        self.longest = np.linalg.norm(self.x, axis=1).max()


def _best(q: np.ndarray, ks: np.ndarray, offered: _Offered) -> tuple[np.ndarray, ...]:
    """(row, column, score, rank) of the best ``ks[row]`` columns of every row.

    Columns are in code order, so equal scores go to the lower code. A single
    precision product finds who can be among the best; the margin covers its
    rounding error, and the survivors are scored again in double precision.
    """
    x, n = offered.x, len(offered.x)
    single = q.astype(np.float32)
    lengths = np.linalg.norm(q, axis=1) * offered.longest
    margin = 4.0 * (q.shape[1] + 4) * np.finfo(np.float32).eps * lengths
    k = min(int(ks.max()), n)
    parts = []
    step = max(1, SCORES_PER_STEP // n)
    for at in range(0, len(q), step):
        rough = single[at : at + step] @ offered.single.T
        floor = np.partition(rough, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(rough >= (floor - margin[at : at + step])[:, None])
        rows += at
        scores = _exact_scores(q, x, rows, cols)
        order = np.lexsort((cols, -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        ranks = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        kept = ranks <= ks[rows]
        parts.append((rows[kept], cols[kept], scores[kept], ranks[kept]))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _search(asked: pa.Table, offered: _Offered, ids: Sequence[str]) -> pa.Table:
    rows, cols, scores, ranks = _best(_matrix(asked["vec"]), asked["k"].to_numpy(), offered)
    columns = {c: asked[c].combine_chunks().take(pa.array(rows)) for c in ids}
    columns["code"] = offered.codes.take(pa.array(cols))
    columns["score"] = pa.array(scores)
    columns["rank"] = pa.array(ranks.astype(np.int32))
    return pa.table(columns)


def _packed_blocks(size: int):
    """Universe rows of a part as Arrow tables in one cell each, of about ``size`` bytes."""

    def pack(part: int, tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), data], ["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in pc.unique(batch.column("part")).to_pylist():
                mine = held.setdefault(part, [])
                mine.append(table.filter(pc.equal(table["part"], part)).select(["code", "vec"]))
                if sum(t.nbytes for t in mine) >= size:
                    yield pack(part, held.pop(part))
        for part, tables in held.items():
            yield pack(part, tables)

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(task, whether they are queries, rows): stretches of rows of a task that are all queries or all blocks."""
    for batch in batches:
        kinds = batch.column("task").to_numpy() * 2 + batch.column("data").is_null().to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)] if len(kinds) else []
        for start, end in zip([0, *ends], ends):
            yield int(kinds[start]) // 2, bool(kinds[start] % 2), batch.slice(start, end - start)


def _tables(piece: pa.RecordBatch) -> Iterator[pa.Table]:
    return (pa.ipc.open_stream(x.as_buffer()).read_all() for x in piece.column("data"))


def _searched(carried: Sequence[str]):
    """Rows sorted by task, a task's blocks before its queries: the queries stream past the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, offered = None, [], None
        for here, asks, piece in _pieces(batches):
            if here != task:
                task, blocks, offered = here, [], None
            if not asks:
                blocks += _tables(piece)
                continue
            if blocks:
                offered, blocks = _Offered(pa.concat_tables(blocks)), []
            if offered is not None:
                yield from _search(pa.Table.from_batches([piece]), offered, carried).to_batches(max_chunksize=1 << 16)

    return run


class _Held:
    """The queries of a task with the best universe rows that each has met so far."""

    def __init__(self, asked: pa.Table, carried: Sequence[str]):
        self.ids = asked.select(carried).combine_chunks()
        self.q = _matrix(asked["vec"])
        self.single = self.q.astype(np.float32)
        self.lengths = np.linalg.norm(self.q, axis=1)
        self.ks = asked["k"].to_numpy()
        self.floor = np.full(len(self.q), -np.inf)  # the score that a full list ends with
        self.best, self.new, self.waiting = None, [], 0

    def meet(self, table: pa.Table) -> None:
        """Note the rows of a block that may be among the best of a query, scored in double precision."""
        x = _matrix(table["vec"])
        single, longest = x.astype(np.float32), np.linalg.norm(x, axis=1).max()
        k, found = int(self.ks.max()), []
        step = max(1, SCORES_PER_STEP // len(x))
        for at in range(0, len(self.q), step):
            rough = self.single[at : at + step] @ single.T
            margin = 4.0 * (x.shape[1] + 4) * np.finfo(np.float32).eps * self.lengths[at : at + step] * longest
            floor = self.floor[at : at + step]
            open_ = rough >= (floor - margin)[:, None]
            if k < len(x) and np.count_nonzero(open_) > 2 * k * len(rough):
                floor = np.maximum(floor, np.partition(rough, len(x) - k, axis=1)[:, len(x) - k])
                open_ = rough >= (floor - margin)[:, None]
            rows, cols = np.nonzero(open_)
            rows += at
            scores = _exact_scores(self.q, x, rows, cols)
            kept = scores >= self.floor[rows]
            found.append((rows[kept], cols[kept], scores[kept]))
        rows, cols, scores = (np.concatenate(column) for column in zip(*found))
        if not len(rows):
            return
        codes = table["code"].combine_chunks().take(pa.array(cols))
        self.new.append(pa.table({"row": rows, "code": codes, "score": scores}))
        self.waiting += len(rows)
        if self.waiting > max(NOTED_ROWS, self.best.num_rows if self.best else 0):
            self.settle()

    def settle(self) -> None:
        """Rank what was noted; equal scores go to the lower code."""
        noted = [t.select(["row", "code", "score"]) for t in (self.best, *self.new) if t is not None]
        noted = pa.concat_tables(noted).combine_chunks().sort_by([("row", "ascending"), ("score", "descending"), ("code", "ascending")])
        rows = noted["row"].to_numpy()
        ranks = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        noted = noted.append_column("rank", pa.array(ranks.astype(np.int32))).filter(pa.array(ranks <= self.ks[rows]))
        rows, ranks = noted["row"].to_numpy(), noted["rank"].to_numpy()
        last = ranks == self.ks[rows]
        self.floor[rows[last]] = noted["score"].to_numpy()[last]
        self.best, self.new, self.waiting = noted, [], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.new:
            self.settle()
        if self.best is not None:
            for part in self.best.to_batches(max_chunksize=1 << 16):
                ids = self.ids.take(part.column("row"))
                columns = {c: ids[c].combine_chunks() for c in ids.column_names}
                columns |= {c: part.column(c) for c in ("code", "score", "rank")}
                yield from pa.table(columns).to_batches()


def _passed(carried: Sequence[str], size: int):
    """Rows sorted by task, a task's queries before its blocks: the universe streams past the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked, held, blocks = None, [], None, []

        def end() -> Iterator[pa.RecordBatch]:
            if held is not None:
                if blocks:
                    held.meet(pa.concat_tables(blocks))
                yield from held.found()

        for here, asks, piece in _pieces(batches):
            if here != task:
                yield from end()
                task, asked, held, blocks = here, [], None, []
            if asks:
                asked.append(pa.Table.from_batches([piece]).select([*carried, "vec"]))
                continue
            if asked:
                held, asked = _Held(pa.concat_tables(asked), carried), []
            if held is None:
                continue
            for table in _tables(piece):
                blocks.append(table)
                if sum(t.nbytes for t in blocks) >= size:
                    held.meet(pa.concat_tables(blocks))
                    blocks = []
        yield from end()

    return run


def _grid(tasks: int, universe_bytes: int, query_bytes: int, found_bytes: int) -> tuple[int, int]:
    """(lanes, parts): a task has a lane of the queries and a part of the universe.

    Every lane is sent the universe and every part the queries, and every part finds rows for them. Of the grids
    with enough tasks the one is taken that sends least, as long as lanes and parts are small enough for a task.
    """
    held = 2 * query_bytes + 3 * found_bytes
    fewest = max(1, -(-held // HELD_BYTES))
    lanes = max(fewest, min(tasks, round((tasks * (query_bytes + 2 * found_bytes) / universe_bytes) ** 0.5)))
    return lanes, max(2, -(-universe_bytes // PART_BYTES), -(-tasks // lanes))


def topk_inner_product(
    queries: DataFrame,
    universe: DataFrame,
    k: int | Column = 40,
    ids: Sequence[str] = ("query_id",),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` universe rows with the highest inner product for every query.

    ``queries`` has the id columns and ``vec``; ``universe`` has a unique ``code``
    and ``embedding``. Returns the ids, code, score and rank; equal scores go to
    the lower code. ``k`` may be a column of the queries.

    A universe of at most ``block_bytes`` is held by every task, and queries stream past it: each is sent once and
    nothing is merged. A larger one is dealt by code into parts and the queries into lanes, a task for each lane and
    part (``_grid``): it holds its queries and their best rows so far, and its part streams past them,
    ``block_bytes`` at a time. The best k of every part are ranked together. Nothing is collected or broadcast.
    """
    ids = list(ids)
    k_column = F.lit(int(k)) if isinstance(k, int) else k
    asked = queries.select(*ids, F.col("vec"), k_column.cast("int").alias("k")).filter(
        F.col("vec").isNotNull() & (F.col("k") > 0)
    )
    offered = universe.select("code", F.col("embedding").alias("vec")).filter(F.col("vec").isNotNull())
    shape = offered.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("vec")).alias("size"),
        F.sum(F.octet_length(F.col("code").cast("string"))).alias("code_bytes"),
    ).first()
    found_fields = [
        T.StructField("code", universe.schema["code"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
    schema = T.StructType([*(queries.schema[c] for c in ids), *found_fields])
    if not shape["n"]:
        return queries.sparkSession.createDataFrame([], schema)
    universe_bytes = shape["n"] * shape["size"] * 8 + (shape["code_bytes"] or 0)
    tasks = min(shuffle_width(queries), 4 * queries.sparkSession.sparkContext.defaultParallelism)
    whole = universe_bytes <= block_bytes
    # Every query row is searched by itself, whatever its ids.
    asked = asked.withColumn("__row", F.monotonically_increasing_id())
    lanes, parts = tasks, 1
    if not whole:
        asked = cut_lineage(asked)  # written once, a row's number lasts
        sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).first()
        rows = sizes["n"] * min(sizes["k"] or 0, shape["n"])
        lanes, parts = _grid(tasks, universe_bytes, sizes["n"] * (shape["size"] * 8 + 64), rows * 32)

    part = F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int").alias("part")
    packed = offered.select("code", "vec", part).mapInArrow(_packed_blocks(min(block_bytes, PACKED_BYTES)), "part int, data binary")
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    blocks = packed.select("part", "data", lane.alias("lane"))
    sent = asked.withColumn("lane", F.pmod("__row", F.lit(lanes)).cast("int"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = blocks.unionByName(sent, allowMissingColumns=True).withColumn("task", F.col("part") * lanes + F.col("lane"))
    first = F.col("data").isNull() if whole else F.col("data").isNotNull()
    met = met.drop("part", "lane").repartitionById(parts * lanes, "task").sortWithinPartitions("task", first)
    if whole:
        return met.mapInArrow(_searched(ids), schema)
    carried = [*ids, "__row", "k"]
    found = met.mapInArrow(_passed(carried, block_bytes), T.StructType([*(asked.schema[c] for c in carried), *found_fields]))
    # A query has at most k rows from each part of the universe.
    w = Window.partitionBy("__row").orderBy(F.col("score").desc(), F.col("code").asc())
    ranked = found.drop("rank").withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= F.col("k")).select(*schema.names)


# --------------------------------------------------------------------------
# Several query texts per record


def merge_by_best_score(
    found: DataFrame,
    record: Sequence[str],
    k: int | None,
    variant: str = "variant",
    bounded: bool = False,
) -> DataFrame:
    """One row per record and code with its best score and the variant that gave it.

    ``bounded`` says that no record has more rows than fit one task, as when k limited each search.
    """
    record = list(record)
    best = found.groupBy(*record, "code").agg(
        F.max("score").alias("score"),
        F.max_by(variant, F.struct(F.col("score"), -F.col(variant))).alias("best_variant"),
    )
    order = [F.col("score").desc(), F.col("code").asc()]
    if k is None and bounded:
        return best.withColumn("rank", F.row_number().over(Window.partitionBy(*record).orderBy(*order)))
    if k is None:
        return number_rows(best, record, order, "rank")
    return first_rows(best, record, order, k, "rank")


def multi_query_topk(
    variants: DataFrame,
    universe: DataFrame,
    k: int = 40,
    cut: bool = True,
    record: str = "record_id",
    **search,
) -> DataFrame:
    """Search every variant (record, variant number, vec) and merge by best score.

    ``cut`` keeps the best k of the merged list; without it all of them stay.
    """
    found = topk_inner_product(variants, universe, k, [record, "variant"], **search)
    return merge_by_best_score(found, [record], k if cut else None)


def search_texts(
    texts: DataFrame, universe: DataFrame, model: PipelineModel, keys: Sequence[str], **search
) -> DataFrame:
    """Top codes for rows of (keys, text, k); equal texts are searched once, with the largest k."""
    keyed = texts.withColumn("digest", F.md5("text"))
    wanted = keyed.groupBy("digest").agg(F.first("text").alias("text"), F.max("k").alias("k"))
    vectors = embed_text(model, wanted)
    found = topk_inner_product(vectors, universe, F.col("k"), ["digest"], **search)
    joined = keyed.select(*keys, "digest", "k").join(found, "digest")
    return joined.filter(F.col("rank") <= F.col("k")).select(*keys, "code", "score", "rank")


def retrieve(
    records: DataFrame,
    universe: DataFrame,
    model: PipelineModel,
    top_k: int = 40,
    synonyms: DataFrame | None = None,
    **search,
) -> DataFrame:
    """Codes retrieved for each record: (record_id, code, score, rank).

    Without ``synonyms`` the text is "code | name". With them (record_id,
    synonyms), the name and each synonym are searched and merged by best score;
    a record without synonyms is searched by its name alone.
    """
    if synonyms is None:
        texts = records.select(
            "record_id", query_text(F.col("code"), F.col("name")).alias("text"), F.lit(top_k).alias("k")
        )
        return search_texts(texts, universe, model, ["record_id"], **search)
    expanded = records.join(synonyms, "record_id", "left")
    texts = expanded.select(
        "record_id",
        F.posexplode(query_variants(F.col("name"), F.col("synonyms"))).alias("variant", "text"),
        F.lit(top_k).alias("k"),
    )
    found = search_texts(texts, universe, model, ["record_id", "variant"], **search)
    return merge_by_best_score(found, ["record_id"], top_k).drop("best_variant")


# --------------------------------------------------------------------------
# Dictionary expansion and the strategies


def triggered(
    records: DataFrame, dictionary: DataFrame, key: str = "record_id", name: str = "name"
) -> DataFrame:
    """Per record the dictionary entries whose trigger occurs in its name, in trigger order.

    The lower-cased name is cut into pieces of the lengths that triggers have, and the
    pieces are joined on the whole trigger, which is unique. An empty trigger occurs in every
    name, a null name has no triggers.
    """
    entries = dictionary.groupBy(F.lower("trigger").alias("trigger")).agg(
        F.min("trigger_pos").alias("trigger_pos"),
        F.array_sort(F.collect_list(F.struct("pos", "synonym"))).alias("synonyms"),
    )
    rows = records.select(key, F.col(name).alias("name"))
    sizes = entries.agg(F.collect_set(F.length("trigger"))).scalar()
    names = rows.filter(F.col("name").isNotNull()).select("name").distinct()
    names = names.select("name", F.lower("name").alias("lowered"), sizes.alias("sizes"))
    fitting = F.filter("sizes", lambda n: n <= F.length("lowered"))
    # One empty piece is enough, so that size has one start.
    last = F.when(F.col("size") == 0, 1).otherwise(F.length("lowered") - F.col("size") + 1)
    pieces = (
        names.select("name", "lowered", F.explode(fitting).alias("size"))
        .select("name", "lowered", "size", F.explode(F.sequence(F.lit(1), last)).alias("start"))
        .select("name", F.substring("lowered", F.col("start"), F.col("size")).alias("trigger"))
    )
    entry = F.struct("trigger_pos", "trigger", "synonyms")
    found = pieces.distinct().join(entries, "trigger")
    hits = found.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    none = F.array().cast(hits.schema["hits"].dataType)
    return rows.join(hits, "name", "left").select(
        key, "name", F.coalesce("hits", none).alias("hits")
    )


def dictionary_expand(
    records: DataFrame,
    dictionary: DataFrame,
    mode: str = "concat",
    key: str = "record_id",
    name: str = "name",
) -> DataFrame:
    """Query texts (record, variant, text) from a dictionary of triggers.

    ``dictionary`` has trigger, trigger_pos, pos and synonym. A trigger applies
    when it occurs anywhere in the name, ignoring case. ``concat`` joins the name
    and the synonyms of all triggers by " | "; ``multi`` gives the name and each
    synonym of the first trigger that applies as texts of their own.
    """
    return expanded_texts(triggered(records, dictionary, key, name), mode, key)


def expanded_texts(rows: DataFrame, mode: str, key: str = "record_id") -> DataFrame:
    """The texts of ``dictionary_expand`` from rows of ``triggered``."""
    words = F.transform("hits", lambda e: F.transform(e["synonyms"], lambda s: s["synonym"]))
    if mode == "concat":
        text = F.concat_ws(" | ", F.col("name"), F.flatten(words))
        return rows.select(key, F.lit(0).alias("variant"), text.alias("text"))
    none = F.array().cast("array<string>")
    texts = F.concat(F.array("name"), F.coalesce(F.get(words, 0), none))
    return rows.select(key, F.posexplode(texts).alias("variant", "text"))


def strategy_texts(records: DataFrame, dictionary: DataFrame, k: int = 40, factor: int = 5) -> DataFrame:
    """Query texts of all strategies: (strategy, record_id, variant, text, k)."""

    def tagged(strategy: str, texts: DataFrame, size: int = k) -> DataFrame:
        return texts.select(
            F.lit(strategy).alias("strategy"), "record_id", "variant", "text", F.lit(size).alias("k")
        )

    single = F.lit(0).alias("variant")
    coded = records.select(
        "record_id", single, query_text(F.col("code"), F.col("name")).alias("text")
    )
    named = records.select("record_id", single, F.col("name").alias("text"))
    found = cut_lineage(triggered(records, dictionary))
    return (
        tagged("baseline", coded)
        .unionByName(tagged("name_only", named))
        .unionByName(tagged("synonym_expansion", expanded_texts(found, "concat")))
        .unionByName(tagged("multi_query", expanded_texts(found, "multi")))
        .unionByName(tagged(f"large_k_{factor}x", named, k * factor))
    )


def retrieval_strategies(
    records: DataFrame,
    universe: DataFrame,
    dictionary: DataFrame,
    model: PipelineModel,
    k: int = 40,
    factor: int = 5,
    **search,
) -> DataFrame:
    """Codes found by each strategy: (strategy, record_id, code, score, rank), in one search."""
    texts = strategy_texts(records, dictionary, k, factor)
    found = search_texts(texts, universe, model, ["strategy", "record_id", "variant"], **search)
    merged = merge_by_best_score(found, ["strategy", "record_id"], None, bounded=True)
    return merged.drop("best_variant")


def rank_of_target(results: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank and score of the wanted code per row of ``targets`` (keys, target); -1 and 0 if absent."""
    keys = list(keys)
    found = results.select(*keys, F.col("code").alias("target"), "rank", "score")
    return targets.join(found, [*keys, "target"], "left").select(
        *keys,
        "target",
        F.coalesce("rank", F.lit(-1)).alias("rank"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def strategy_summary(results: DataFrame, targets: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Per strategy and record, whether and where the wanted code (record_id, target) was found."""
    names = F.explode(F.array(*map(F.lit, strategies))).alias("strategy")
    wanted = targets.select("record_id", "target", names)
    placed = rank_of_target(results, wanted, ["strategy", "record_id"])
    return placed.withColumn("found", F.col("rank") > 0)


def strategy_listing(results: DataFrame, universe: DataFrame, n: int = 20) -> DataFrame:
    """The first n codes of every list with their names; ``<missing>`` for unknown codes."""
    names = universe.select("code", "name")
    top = results.filter(F.col("rank") <= n)
    return top.join(names, "code", "left").select(
        *results.columns, F.coalesce("name", F.lit("<missing>")).alias("name")
    )


# --------------------------------------------------------------------------
# Lookups and blocking


def lookup_name(rows: DataFrame, universe: DataFrame, code: str, name: str = "name") -> DataFrame:
    """Add the universe's name of ``code``, null where the code is unknown."""
    names = universe.select(F.col("code").alias(code), F.col("name").alias(name))
    return rows.join(names, code, "left")


def exists(rows: DataFrame, universe: DataFrame, code: str) -> DataFrame:
    """Rows whose code is in the universe."""
    return rows.join(universe.select(F.col("code").alias(code)), code, "left_semi")


def block_key(code: Column, length: int = 3) -> Column:
    """Leading characters of a code, to block by chapter."""
    return F.substring(code, 1, length)


def sharing_token(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose two texts have a word in common; only the given pairs are looked at."""
    shared = F.arrays_overlap(token_set(F.col(left)), token_set(F.col(right)))
    return pairs.filter(shared)


def within_block(pairs: DataFrame, left: str, right: str, length: int = 3) -> DataFrame:
    """Pairs whose two codes lie in the same block, with the block."""
    same = block_key(F.col(left), length) == block_key(F.col(right), length)
    return pairs.filter(same).withColumn("block", block_key(F.col(left), length))
