"""Tables of (query, candidate, features, label): cleaning, splitting, simple scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.operators.skew import first_rows
from termbridge.schemas import PairSpec


def clean_pairs(df: DataFrame, spec: PairSpec, order: Sequence[Column] = ()) -> DataFrame:
    """Keep the pair columns, drop rows with a missing feature or label, and keep
    the first row of each (query, doc) in the given order (then in column order)."""
    kept = [*order, *[F.col(c) for c in spec.columns]]
    complete = df.dropna(subset=[*spec.features, spec.label])
    return first_rows(complete, [spec.query, spec.doc], kept).select(*spec.columns)


def group_fold(df: DataFrame, query: str, n: int = 5, key: Column | None = None) -> DataFrame:
    """Add ``fold``; all rows of a query share one, so no query is on both sides."""
    return df.withColumn("fold", F.pmod(F.hash(query) if key is None else key, F.lit(n)).cast("int"))


def train_test(df: DataFrame, test_fold: int = 4) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("fold") < test_fold), df.filter(F.col("fold") == test_fold)


def split_summary(df: DataFrame, spec: PairSpec, test_fold: int = 4) -> DataFrame:
    """Rows, queries and positive rate on each side of the split."""
    return (
        df.filter(F.col("fold") <= test_fold)
        .groupBy((F.col("fold") == test_fold).alias("is_test"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(spec.query).alias("n_queries"),
            F.avg(F.col(spec.label).cast("double")).alias("positive_rate"),
        )
    )


def equal_weight_score(
    df: DataFrame,
    features: Sequence[str],
    weights: Mapping[str, float] | None = None,
    how: str = "mean",
    name: str = "score",
) -> DataFrame:
    """Mean of the features, or their weighted sum with ``how='sum'``."""
    weighted = [F.col(f) * float((weights or {}).get(f, 1.0)) for f in features]
    total = reduce(lambda a, b: a + b, weighted)
    return df.withColumn(name, total / F.lit(float(len(features))) if how == "mean" else total)


def threshold_label(df: DataFrame, score: str, threshold: float, name: str = "pred") -> DataFrame:
    """1 where the score reaches the threshold, else 0."""
    return df.withColumn(name, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def label_sanity(df: DataFrame, spec: PairSpec) -> DataFrame:
    """Queries that have no positive or several."""
    return (
        df.groupBy(spec.query)
        .agg(F.sum(F.col(spec.label).cast("long")).alias("n_positive"))
        .filter(F.col("n_positive") != 1)
    )


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def synthetic_pairs(queries: DataFrame, query: str, seed: int = 7) -> DataFrame:
    """Labelled pairs for every given query key: 5 to 20 candidates, one of them right.

    Every random number is a digest of (seed, query, candidate, use), so the rows
    do not depend on how the input is partitioned.
    """

    def uniform(*parts: Column | str) -> Column:
        named = [p if isinstance(p, Column) else F.lit(p) for p in parts]
        return hashed_uniform(F.lit(str(seed)), *named)

    key = F.col(query).cast("string")
    sized = queries.select(
        query,
        (5 + F.floor(uniform(key, "size") * 16)).cast("int").alias("n_docs"),
    ).withColumn("gold", F.floor(uniform(key, "gold") * F.col("n_docs")).cast("int"))
    rows = sized.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1)))
    right = F.col("j") == F.col("gold")
    base = F.when(right, F.lit(0.6)).otherwise(F.lit(0.2))

    def feature(name: str, share: float) -> Column:
        value = uniform(key, F.col("j").cast("string"), name) * 0.3 + base * share
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias(name)

    # How strongly each feature follows the label.
    shares = {
        "cosine_tfidf_word": 1.0,
        "jaccard_tokens": 0.8,
        "dice_tokens": 0.85,
        "levenshtein_ratio": 0.9,
        "cos_similarity": 0.95,
    }
    doc_key = F.when(right, key).otherwise(F.concat(key, F.lit("x"), F.col("j").cast("string")))
    return rows.select(
        F.concat(F.lit("9_"), key).alias("icd9_code"),
        F.concat(F.lit("phenotype_"), key).alias("icd9_phe"),
        F.concat_ws("_", F.lit("10"), key, F.lpad(F.col("j").cast("string"), 2, "0")).alias("icd10_code"),
        F.concat(F.lit("phenotype_"), doc_key).alias("icd10_phe"),
        *[feature(n, s) for n, s in shares.items()],
        right.cast("int").alias("correct"),
    )
