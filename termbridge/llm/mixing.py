"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source wants the same number of copies, target / size of the source. The whole
part is given to all; what remains is a probability between 0 and 1. Documents are paired, and
a pair moves mass at random, in units of words, until one of them wants a whole number: then it is
settled and the other goes on with the rest. Expected copies stay as wanted and the words of a
source stay the same at each step. Blocks of about ``BLOCK`` documents are folded inside a task;
their last undecided documents form the blocks of the next level, so a source of any size
takes log(size) / log(BLOCK) shuffles of ever fewer rows. At the end one document of a
source is rounded by chance.

Rows that are alike in doc_id, source and text share their copies evenly: of n such rows n * p more copies are
wanted, the whole part is given to the first and only the rest is drawn. They are numbered by the file
they come from, so a row that repeats gathers in one task a file only, and the numbers do not depend on
how the scan is split: executors may come and go between the two reads.

Random numbers are hashes of the document, its text and the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termbridge.session import cut_lineage

col = F.col
WEIGHTS = (5.0, 2.0, 1.0)  # of the sources by code point, null last, repeating
MOST = 3  # copies of a document, and target against size of a source
BLOCK = 128
WORD = r"[^\x20\x09-\x0D]+"
SMALL = 1e-9  # a probability this near to 0 or 1 is whole


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the values alone."""
    return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in the order of code points, null last, counted over range partitions."""
    ordered = sources.withColumn("missing", col("source").isNull())
    width = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = ordered.repartitionByRange(width, "missing", "source").withColumn("part", F.spark_partition_id())
    ordered = cut_lineage(ordered)
    within = Window.partitionBy("part").orderBy("missing", "source")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = (F.row_number().over(within) + col("before") - 1).alias("place")
    return ordered.join(before, "part").select("source", "source_size", "n_docs", place)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """Adds weight and target words: by weight, at most ``MOST`` times the size, the excess reshared.

    Each round fixes the sources whose share by weight is above their limit; every round
    fixes at least one, and the rest is shared anew.
    """
    turn = F.pmod(col("place"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = cut_lineage(ranked(sources).withColumn("weight", weight).withColumn("most", MOST * col("source_size").cast("double")))
    # The share of one unit of weight only rises, so a source once at its limit stays there.
    level = 0.0
    total = rows.agg((F.sum("source_size") * F.lit(share)).cast("double")).first()[0] or 0.0
    while True:
        full = F.coalesce(col("most") <= col("weight") * level, F.lit(False))
        fixed, free = rows.agg(F.sum(F.when(full, col("most"))), F.sum(F.when(~full, col("weight")))).first()
        if not free:
            break
        higher = (total - (fixed or 0.0)) / free
        if higher <= level:
            break
        level = higher
    return rows.withColumn("target", F.least("most", col("weight") * level)).drop("most")


def _fold(items: Column) -> Column:
    """Folds an array of (row, p, size, u, v) pairwise: settled = (row, copy), last = the undecided.

    For a pair with probabilities p, q and sizes s, t the mass moves either way by as many words as
    settle one of them, with chances that keep both expectations.
    """
    settled = F.array().cast("array<struct<row:bigint,copy:int>>")
    nobody = F.lit(None).cast("struct<row:bigint,p:double,size:bigint>")

    def step(state: Column, item: Column) -> Column:
        p, s, q, t = state["last"]["p"], state["last"]["size"], item["p"], item["size"]
        up = F.least((1 - p) * s, q * t)  # words from the item to the last
        down = F.least(p * s, (1 - q) * t)
        rises = item["u"] * (up + down) < down
        new_p = F.when(rises, p + up / s).otherwise(p - down / s)
        new_q = F.when(rises, q - up / t).otherwise(q + down / t)
        p_whole = (new_p < SMALL) | (new_p > 1 - SMALL)
        q_whole = (new_q < SMALL) | (new_q > 1 - SMALL)
        last = lambda row, p_, size: F.struct(row.alias("row"), p_.alias("p"), size.alias("size"))
        done = lambda row, p_: F.struct(row.alias("row"), F.round(p_).cast("int").alias("copy"))
        first, second = done(state["last"]["row"], new_p), done(item["row"], new_q)
        met = F.when(
            p_whole & q_whole, F.struct(F.concat(state["settled"], F.array(first, second)).alias("settled"), nobody.alias("last"))
        ).when(
            p_whole,
            F.struct(F.concat(state["settled"], F.array(first)).alias("settled"), last(item["row"], new_q, t).alias("last")),
        ).otherwise(F.struct(F.concat(state["settled"], F.array(second)).alias("settled"), last(state["last"]["row"], new_p, s).alias("last")))
        start = F.struct(state["settled"].alias("settled"), last(item["row"], q, t).alias("last"))
        return F.when(state["last"].isNull(), start).otherwise(met)

    return F.aggregate(items, F.struct(settled.alias("settled"), nobody.alias("last")), step)


def rounded(rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Of (row, source, p, size) with 0 < p < 1 and size > 0: (row, copy) with copy 0 or 1."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0]
    if most is None:
        return rows.select("row", F.lit(0).alias("copy"))
    counts = counts.withColumnRenamed("source", "s")
    now = rows.join(counts, col("source").eqNullSafe(col("s"))).select("row", "source", "p", "size", "n")
    out, level = None, 0
    while True:
        level += 1
        n_blocks = F.greatest(F.ceil(col("n") / float(block) ** level), F.lit(1))
        where = F.pmod(F.xxhash64("row", F.lit(seed), F.lit(level)), n_blocks)
        item = F.struct(uniform("row", F.lit(level), seed=seed + 1).alias("u"), "row", "p", "size")
        grouped = now.groupBy("source", where.alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
        folded = cut_lineage(grouped.select("source", "n", _fold(col("items")).alias("state")))
        settled = folded.select(F.inline("state.settled"))
        out = settled if out is None else out.unionByName(settled)
        rest = folded.where("state.last IS NOT NULL").select(
            col("state.last.row").alias("row"), "source", col("state.last.p").alias("p"), col("state.last.size").alias("size"), "n"
        )
        if block**level >= most:
            chance = F.when(uniform("row", seed=seed + 2) < col("p"), 1).otherwise(0)
            return out.unionByName(rest.select("row", chance.alias("copy")))
        now = rest


def _from_files(documents: DataFrame) -> DataFrame:
    """``documents`` if Spark can tell the file of a row, else written once."""
    try:
        documents.select(F.input_file_name())
    except AnalysisException as error:
        if error.getCondition() != "MULTI_SOURCES_UNSUPPORTED_FOR_EXPRESSION":
            raise
        return cut_lineage(documents)
    return documents


def mix_sources(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights=WEIGHTS,
    share: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """``documents`` with size, source_size, target (of the source, in words), copies and taken (words).

    A null or empty text has size 0, takes nothing and has 0 copies. Rows without a source form
    the last source. Rows without a doc_id or with the same one are drawn one by one; of rows alike in doc_id, source
    and text, some get one copy more than others. Sources without words have target 0. Input columns
    with the five names are replaced. An empty table gives no rows. ``share`` is the size of the mix
    against all words. ``documents`` is best a scan of files; a join of files is written first (Spark refuses
    file names above it). Rows that come from no file are all of one part.
    """
    documents = _from_files(documents)
    made = ["size", "source_size", "target", "copies", "taken"]
    carried = [c for c in documents.columns if c not in made]
    words = F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.xxhash64(col(doc_id), col(source), col(text)).alias("__row")
    inputs = documents.select(*[col(f"`{c}`") for c in carried], words.alias("size"), col(source).alias("__source"), row)
    inputs = inputs.withColumn("__part", F.xxhash64(F.input_file_name()))
    groups = inputs.groupBy("__row", col("__source").alias("source"), "size", "__part").agg(F.count("*").alias("n"))
    alike = Window.partitionBy("__row", "source", "size")  # at most a row per part
    earlier = alike.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    groups = cut_lineage(
        groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("all", F.sum("n").over(alike))
    )
    totals = groups.groupBy("source").agg(F.sum(col("size") * col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    wanted = targets(totals, weights, share)
    ratio = F.when(col("source_size") > 0, F.least(col("target") / col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    whole = F.floor(ratio + SMALL)
    part = ratio - whole
    rates = cut_lineage(
        wanted.select(
            col("source").alias("s"),
            "source_size",
            "target",
            whole.cast("int").alias("whole"),
            F.when(part > SMALL, part).otherwise(F.lit(0.0)).alias("p"),
        )
    )
    # Of n rows alike n * p get one copy more: the whole part of them surely, one by chance.
    more = col("all") * col("p")
    due = groups.join(rates, col("source").eqNullSafe(col("s"))).where("p > 0 AND size > 0")
    due = due.withColumn("sure", F.floor(more + SMALL)).withColumn("rest", more - F.floor(more + SMALL))
    drawn = due.where((col("before") == 0) & (col("rest") > SMALL)).select(col("__row").alias("row"), "source", col("rest").alias("p"), "size")
    drawn = rounded(drawn, seed).select(col("row").alias("__row"), "copy")
    due = due.join(drawn, "__row", "left")
    extra = F.least(col("sure") + F.coalesce("copy", F.lit(0)) - col("before"), col("n"))
    due = due.select("__row", "__part", extra.cast("int").alias("extra")).where("extra > 0")
    nth = F.row_number().over(Window.partitionBy("__row", "__part").orderBy("__part"))
    done = inputs.withColumn("__nth", nth).join(due, ["__row", "__part"], "left").join(rates, col("__source").eqNullSafe(col("s")), "left")
    copies = F.when(col("size") > 0, col("whole") + (col("__nth") <= F.coalesce("extra", F.lit(0))).cast("int")).otherwise(F.lit(0))
    done = done.withColumn("copies", copies).withColumn("taken", col("copies") * col("size"))
    return done.select(*[col(f"`{c}`") for c in carried], *made)
