"""Per-query ranking of scored pairs and the measures built on it.

Order is always score descending, then doc ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.operators.skew import first_rows, number_rows, running_sums


def _order(score: str, doc: str) -> list[Column]:
    return [F.col(score).desc(), F.col(doc).asc()]


def rank_candidates(df: DataFrame, query: str, score: str, doc: str) -> DataFrame:
    """Add ``rank`` from 1 within each query."""
    return number_rows(df, [query], _order(score, doc), "rank")


def best_per_query(df: DataFrame, query: str, score: str, doc: str) -> DataFrame:
    return first_rows(df, [query], _order(score, doc))


def top1_accuracy(df: DataFrame, query: str, score: str, doc: str, label: str) -> DataFrame:
    """Share of queries whose best candidate is right."""
    best = best_per_query(df, query, score, doc)
    return best.agg(F.avg(F.col(label).cast("double")).alias("top1_accuracy"))


def precision_at_k(
    df: DataFrame, query: str, score: str, doc: str, label: str, k: int = 1, divide_by_k: bool = False
) -> DataFrame:
    """Mean share of positives among the first k of each query.

    A query with fewer than k candidates divides by its own count, unless
    ``divide_by_k`` is set.
    """
    hits = first_rows(df, [query], _order(score, doc), k).groupBy(query).agg(
        F.sum(F.col(label).cast("double")).alias("hits"), F.count(F.lit(1)).alias("n")
    )
    size = F.lit(float(k)) if divide_by_k else F.col("n")
    return hits.agg(F.avg(F.col("hits") / size).alias("precision_at_k"))


def query_measures(df: DataFrame, query: str, score: str, doc: str, label: str, k: int = 1) -> DataFrame:
    """Average precision, reciprocal rank and precision at k of each query."""
    positive = (F.col(label) == 1).cast("long")
    ranked = running_sums(
        df.select(query, doc, score, label),
        [query],
        _order(score, doc),
        {"rank": F.lit(1), "found": positive},
    )
    hit = F.col(label) == 1
    return ranked.groupBy(query).agg(
        F.coalesce(
            F.sum(F.when(hit, F.col("found").cast("double") / F.col("rank")))
            / F.nullif(F.max("found"), F.lit(0)),
            F.lit(0.0),
        ).alias("average_precision"),
        F.coalesce(F.lit(1.0) / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias(
            "reciprocal_rank"
        ),
        F.avg(F.when(F.col("rank") <= k, F.col(label).cast("double"))).alias("precision_at_k"),
        F.max(F.when(F.col("rank") == 1, F.col(label).cast("double"))).alias("top1"),
    )


def mean_average_precision(df, query, score, doc, label) -> DataFrame:
    """Mean over queries of the mean precision at each positive; 0 for a query without one."""
    measures = query_measures(df, query, score, doc, label)
    return measures.agg(F.avg("average_precision").alias("mean_average_precision"))


def mean_reciprocal_rank(df, query, score, doc, label) -> DataFrame:
    """Mean over queries of 1 / rank of the first positive; 0 for a query without one."""
    measures = query_measures(df, query, score, doc, label)
    return measures.agg(F.avg("reciprocal_rank").alias("mean_reciprocal_rank"))


def ranking_report(df, query, score, doc, label, k=1) -> DataFrame:
    """MAP, MRR, P@k and top-1 accuracy in one row, from one ranking of the pairs."""
    return query_measures(df, query, score, doc, label, k).agg(
        F.avg("average_precision").alias("map"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("precision_at_k").alias("p_at_k"),
        F.avg("top1").alias("top1_accuracy"),
    )


def ranked_lists(
    df: DataFrame,
    query: str,
    score: str,
    doc: str,
    label: str,
    slice_rows: int = 10_000,
) -> DataFrame:
    """Docs of each query in ranked order, and the right docs among them.

    A list longer than ``slice_rows`` goes on in further rows (``part`` 1, 2, ...).
    """
    ranked = rank_candidates(df.select(query, doc, score, label), query, score, doc)
    part = F.floor((F.col("rank") - 1) / F.lit(slice_rows)).cast("int")
    lists = ranked.groupBy(query, part.alias("part")).agg(
        F.collect_list(F.struct("rank", doc)).alias("ranked"),
        F.array_sort(F.collect_set(F.when(F.col(label) == 1, F.col(doc)))).alias("truth"),
    )
    ordered = F.transform(F.array_sort("ranked"), lambda x: x[doc])
    return lists.select(query, "part", ordered.alias("docs"), "truth")


def decide(df: DataFrame, query: str, score: str, doc: str, threshold: float) -> DataFrame:
    """The best candidate of each query with ``accept`` 1 if its score reaches the threshold."""
    best = best_per_query(df, query, score, doc)
    return best.withColumn("accept", (F.col(score) >= F.lit(float(threshold))).cast("int"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of the whole table, for reports."""
    return df.orderBy(*order).limit(n)
