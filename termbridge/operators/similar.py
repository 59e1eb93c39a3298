"""Candidate pairs by shared tokens: all pairs of texts whose token sets are similar enough.

A prefix-filtered set-similarity join. The tokens of a set are numbered in order of rarity. Two sets of n and m
tokens that reach the threshold share at least ``need(n, m)`` tokens, so they share one among the first
n - need + 1 of each: only those index a set, and common tokens, which come last, rarely do.

Sets are dealt into blocks, and every two blocks meet in a cell, where ``overlap`` goes through the shared
tokens and counts. A set is sent as often as there are blocks on the other side; candidates that turn out not to be
similar never leave the task, so what is written grows with the sets and the pairs found. Equal sets are one set until
the end.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.functions.similarity import token_set
from termbridge.operators.overlap import FOUND, overlapping
from termbridge.operators.skew import number_rows
from termbridge.session import cut_lineage, shuffle_width

col = F.col
CELL_ROWS = 1 << 19  # sets of a block; a cell has two blocks
CELL_TOKENS = 8 << 20  # tokens of a block
LEAST_ROWS = 1000  # sets of a block that is smaller only to keep more cores busy


def _ratio(threshold: float, measure: str) -> Fraction:
    """The Jaccard similarity that the threshold asks for, exactly."""
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    if measure not in ("jaccard", "dice"):
        raise ValueError(f"unknown measure {measure}")
    return t if measure == "jaccard" else t / (2 - t)


def token_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: ``key``, class_id (the smallest key with the same token set) and the tokens, sorted.

    Texts without tokens and rows without key have no row. Keys may repeat.
    """
    rows = df.select(col(key).alias("key"), F.array_join(F.array_sort(token_set(col(text))), " ").alias("tokens"))
    rows = rows.where("key is not null and tokens <> ''")
    classes = rows.groupBy("tokens").agg(F.min("key").alias("class_id"))
    return rows.join(classes, "tokens").select(col("key").alias(key), "class_id", "tokens")


def _digest() -> Column:
    """The name of a token set."""
    return F.unhex(F.md5("tokens"))


def _sets(members: DataFrame, side: int) -> DataFrame:
    """Every token set once."""
    return members.select("tokens").distinct().select(F.lit(side).alias("side"), _digest().alias("id"), F.split("tokens", " ").alias("tokens"))


def _by_rarity(sets: DataFrame) -> DataFrame:
    """The tokens of every set as numbers, the rarest first."""
    each = sets.select("side", "id", F.explode("tokens").alias("token"))
    counts = cut_lineage(each.groupBy("token").agg(F.count("*").alias("n")))
    numbered = number_rows(counts, [], [col("n"), col("token")], "number").select("token", "number")
    return each.join(numbered, "token").groupBy("side", "id").agg(F.array_sort(F.collect_list("number")).alias("tokens"))


def _blocks(sets: DataFrame, cell_rows: int) -> list[int]:
    """Blocks of either side: as many as memory asks for, and enough to give every core a few cells."""
    found = {r["side"]: r for r in sets.groupBy("side").agg(F.count("*").alias("rows"), F.sum(F.size("tokens")).alias("tokens")).collect()}
    spread_out = math.ceil(math.sqrt(4 * shuffle_width(sets)))
    out = []
    for side in (0, 1):
        rows, tokens = (found[side]["rows"], found[side]["tokens"]) if side in found else (0, 0)
        held = max(math.ceil(rows / cell_rows), math.ceil(tokens / CELL_TOKENS))
        out.append(max(1, held, min(spread_out, rows // LEAST_ROWS)))
    return out


def _paired(sets: DataFrame, own: bool, t: Fraction, cell_rows: int) -> DataFrame:
    """Pairs (a, b, both, total) of sets that reach the similarity, with the tokens that both have and those of each in all.

    Every block of one side meets every block of the other in a cell of its own; of one table, two blocks meet once.
    """
    lefts, rights = _blocks(sets, cell_rows)
    rights = lefts if own else rights
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if own:
        placed = sets.withColumn("k", block(lefts)).withColumn("with", other(lefts))
        cell = F.least("k", "with") * F.lit(rights) + F.greatest("k", "with")
        placed = placed.select(cell.alias("cell"), (col("k") > col("with")).cast("int").alias("part"), "id", "tokens")
    else:
        a = sets.where("side = 0").withColumn("k", block(lefts)).withColumn("with", other(rights))
        b = sets.where("side = 1").withColumn("k", block(rights)).withColumn("with", other(lefts))
        a = a.select((col("k") * rights + col("with")).alias("cell"), F.lit(0).alias("part"), "id", "tokens")
        b = b.select((col("with") * rights + col("k")).alias("cell"), F.lit(1).alias("part"), "id", "tokens")
        placed = a.unionAll(b)
    alone = frozenset(k * rights + k for k in range(lefts)) if own else frozenset()
    tasks = max(shuffle_width(sets), lefts * rights // 4)
    # By range, as cells are alike: a hash would give some tasks several and others none.
    return placed.repartitionByRange(tasks, "cell").sortWithinPartitions("cell").mapInArrow(overlapping(t, alone), FOUND)


def _similar_sets(left: DataFrame, right: DataFrame | None, t: Fraction, measure: str, cell_rows: int) -> DataFrame:
    """Pairs (a, b, similarity) of token sets, of one table each pair once."""
    own = right is None
    sets = _sets(left, 0) if own else _sets(left, 0).unionAll(_sets(right, 1))
    met = _paired(cut_lineage(_by_rarity(sets)), own, t, cell_rows)
    value = col("both") / (col("total") - col("both")) if measure == "jaccard" else 2 * col("both") / col("total")
    return met.select("a", "b", value.alias("similarity"))


def similar_classes(
    left: DataFrame, right: DataFrame | None, threshold: float, measure: str = "jaccard", cell_rows: int = CELL_ROWS, depth: int | None = None
) -> DataFrame:
    """Pairs of classes (left_class, right_class, similarity) at or above the threshold.

    ``left`` and ``right`` are ``token_classes``; without ``right``, pairs of different classes of ``left``, the
    smaller one as left_class. ``cell_rows`` changes the plan, not the pairs; ``depth`` is of no effect any more.
    """
    found = _similar_sets(left, right, _ratio(threshold, measure), measure, cell_rows)
    for members, end in ((left, "a"), (left if right is None else right, "b")):
        found = found.join(members.groupBy(_digest().alias(end)).agg(F.min("class_id").alias(f"class_{end}")), end)
    ends = (F.least("class_a", "class_b"), F.greatest("class_a", "class_b")) if right is None else (col("class_a"), col("class_b"))
    return found.select(ends[0].alias("left_class"), ends[1].alias("right_class"), "similarity")


def similar_pairs(
    left: DataFrame,
    right: DataFrame | None,
    key: str,
    text: str,
    threshold: float,
    measure: str = "jaccard",
    right_key: str | None = None,
    right_text: str | None = None,
    cell_rows: int = CELL_ROWS,
    depth: int | None = None,
) -> DataFrame:
    """All pairs (left_key, right_key, similarity) whose token sets reach the threshold, row by row of the keys.

    Without ``right``, pairs of rows of ``left`` with left_key < right_key. Classes of equal sets are expanded
    last: a class of many keys gives as many rows as it has pairs, so work with ``token_classes`` and
    ``similar_classes`` where copies abound.
    """
    t = _ratio(threshold, measure)
    mine = cut_lineage(token_classes(left, key, text))
    theirs = mine if right is None else cut_lineage(token_classes(right, right_key or key, right_text or text))
    links = _similar_sets(mine, None if right is None else theirs, t, measure, cell_rows)
    if right is None:
        same = mine.select(_digest().alias("a"), _digest().alias("b")).distinct().withColumn("similarity", F.lit(1.0))
        links = links.unionAll(same)
    a = mine.select(col(mine.columns[0]).alias("left_key"), _digest().alias("a"))
    b = theirs.select(col(theirs.columns[0]).alias("right_key"), _digest().alias("b"))
    pairs = links.join(a, "a").join(b, "b")
    if right is None:
        # Links of different sets come once, whichever key is smaller; those of a set with itself from both ends.
        pairs = pairs.where("case when a = b then left_key < right_key else left_key <> right_key end")
        pairs = pairs.withColumns({"left_key": F.least("left_key", "right_key"), "right_key": F.greatest("left_key", "right_key")})
    return pairs.select("left_key", "right_key", "similarity")


def similar_links(
    left: DataFrame,
    right: DataFrame | None,
    key: str,
    text: str,
    threshold: float,
    measure: str = "jaccard",
    right_key: str | None = None,
    right_text: str | None = None,
    cell_rows: int = CELL_ROWS,
    depth: int | None = None,
) -> DataFrame:
    """Per row of ``left``: key, class_id and n_links, the rows of ``right`` (or other rows of ``left``) that it resembles.

    Links are those of ``similar_pairs``; copies are counted by class and never paired. A row without tokens is
    a class of its own without links; rows without key have no row.
    """
    mine = cut_lineage(token_classes(left, key, text).select(col(key).alias("key"), "class_id", "tokens"))
    theirs = mine if right is None else cut_lineage(token_classes(right, right_key or key, right_text or text))
    classes = cut_lineage(similar_classes(mine, None if right is None else theirs, threshold, measure, cell_rows))
    ends = classes.select(col("left_class").alias("class_id"), col("right_class").alias("other"))
    if right is None:
        ends = ends.unionAll(ends.select("other", "class_id"))
    sizes = theirs.groupBy(col("class_id").alias("other")).agg(F.count("*").alias("size"))
    counts = ends.join(sizes, "other").groupBy("class_id").agg(F.sum("size").alias("n"))
    if right is None:
        copies = sizes.select(col("other").alias("class_id"), (col("size") - 1).alias("n"))
        counts = counts.unionAll(copies).groupBy("class_id").agg(F.sum("n").alias("n"))
    linked = mine.join(counts, "class_id", "left").select(col("key").alias(key), "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))
    bare = left.where(col(key).isNotNull() & (F.size(token_set(col(text))) == 0))
    return linked.unionAll(bare.select(key, col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links")))
