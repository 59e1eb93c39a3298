"""Counts, distributions and histograms of a pair table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termbridge.operators.skew import running_sums
from termbridge.schemas import PairSpec
from termbridge.session import cut_lineage


def dataset_summary(df: DataFrame, spec: PairSpec) -> DataFrame:
    positive = F.col(spec.label) == 1
    return df.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_distinct(spec.query).alias("n_queries"),
        F.count_distinct(spec.doc).alias("n_docs"),
        F.sum(positive.cast("long")).alias("n_positive"),
        F.sum((~positive).cast("long")).alias("n_negative"),
        F.avg(positive.cast("double")).alias("positive_share"),
        F.avg((~positive).cast("double")).alias("negative_share"),
    )


def long_features(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per feature value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    return (
        df.select(*by, F.explode(pairs).alias("f"))
        .select(*by, "f.feature", F.col("f.value").cast("double").alias("value"))
        .filter(F.col("value").isNotNull())
    )


def feature_describe(
    df: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per feature.

    Quartiles interpolate linearly between the two neighbouring values. They are
    read off running counts of the distinct values, so no task holds a whole column.
    """
    keys = [*by, "feature"]
    values = long_features(df, features, by)
    # One row per feature and ``by`` value.
    moments = cut_lineage(
        values.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    counted = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("value").asc()]
    upto = running_sums(counted, keys, order, {"upto": F.col("n")})
    sizes = moments.select(*keys, "count")
    placed = upto.join(sizes, keys)
    quarters = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("value")))

    def place(p: float) -> Column:
        return (F.col("count") - 1) * F.lit(p)

    ends = placed.groupBy(*keys).agg(
        F.max("count").alias("count"),
        *[at(F.floor(place(p))).alias(f"{q}_low") for q, p in quarters.items()],
        *[at(F.ceil(place(p))).alias(f"{q}_high") for q, p in quarters.items()],
    )
    quartiles = ends.select(
        *keys,
        *[
            (
                F.col(f"{q}_low")
                + (F.col(f"{q}_high") - F.col(f"{q}_low")) * (place(p) - F.floor(place(p)))
            ).alias(q)
            for q, p in quarters.items()
        ],
    )
    return moments.join(quartiles, keys).select(
        *keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def group_sizes(df: DataFrame, query: str) -> DataFrame:
    """How many queries have each number of candidates."""
    sizes = df.groupBy(query).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_queries"))


def candidates_per_query(df: DataFrame, query: str) -> DataFrame:
    """Mean, median, smallest and largest number of candidates per query."""
    sizes = group_sizes(df, query)
    return sizes.agg(
        (F.sum(F.col("size") * F.col("n_queries")) / F.sum("n_queries")).alias("mean"),
        F.percentile("size", 0.5, F.col("n_queries")).alias("median"),
        F.min("size").alias("min"),
        F.max("size").alias("max"),
    )


FEW_GROUPS = 10_000


def histogram(values: DataFrame, by: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over each group's own range, empty bins included.

    ``values`` has columns ``by``, ``value`` and the weight ``n``; it is read once
    for the ranges and once for the counts, and only counts are shuffled. The last
    bin holds its upper end; a group of equal values gets the range value -/+ 0.5.
    """
    by = list(by)
    ends = values.groupBy(*by).agg(
        F.min("value").cast("double").alias("least"), F.max("value").cast("double").alias("most")
    )
    flat = F.col("least") == F.col("most")
    ranges = cut_lineage(
        ends.select(
            *by,
            F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("low"),
            F.when(flat, F.col("most") + 0.5).otherwise(F.col("most")).alias("high"),
        )
    )
    if by:
        few = ranges.count() <= FEW_GROUPS
        joined = values.join(F.broadcast(ranges) if few else ranges, by)
    else:
        joined = values.withColumns({c: ranges.select(c).scalar() for c in ("low", "high")})
    low, width = F.col("low"), (F.col("high") - F.col("low")) / F.lit(float(bins))
    value = F.col("value").cast("double")
    guess = F.floor((value - low) * F.lit(float(bins)) / (F.col("high") - low)).cast("int")
    guess = F.least(guess, F.lit(bins - 1))
    moved = (
        F.when(value < low + guess * width, guess - 1)
        .when((value >= low + (guess + 1) * width) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    counts = joined.groupBy(*by, moved.alias("bin")).agg(F.sum("n").alias("n"))
    empty = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return empty.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (low + F.col("bin") * width).alias("low"),
        (low + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def group_size_histogram(df: DataFrame, query: str, bins: int = 30) -> DataFrame:
    """How many queries fall in each band of candidate counts."""
    sizes = group_sizes(df, query).select(F.col("size").alias("value"), F.col("n_queries").alias("n"))
    return histogram(sizes, [], bins)


def class_conditional_histogram(
    df: DataFrame, features: Sequence[str], label: str, bins: int = 30
) -> DataFrame:
    """Density of every feature for each label, over that label's own range."""
    keys = ["feature", label]
    values = long_features(df, features, [label]).withColumn("n", F.lit(1).cast("long"))
    binned = histogram(values, keys, bins)
    total = F.sum("n").over(Window.partitionBy(*keys))  # of the bins of one group
    width = F.col("high") - F.col("low")
    return binned.withColumn("density", F.col("n") / (total * width))


def accepted_errors(decisions: DataFrame, label: str) -> DataFrame:
    accepted = decisions.filter(F.col("accept") == 1)
    return accepted.withColumn("is_error", (F.col(label) != 1).cast("int"))


def error_summary(decisions: DataFrame, label: str) -> DataFrame:
    return accepted_errors(decisions, label).agg(
        F.count(F.lit(1)).alias("n_accepted"),
        F.coalesce(F.sum(F.col("is_error").cast("long")), F.lit(0)).alias("n_errors"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
    )


def worst_errors(decisions: DataFrame, label: str, score: str, doc: str, n: int = 10) -> DataFrame:
    """The n wrong accepted decisions with the highest score, for a report."""
    wrong = accepted_errors(decisions, label).filter(F.col("is_error") == 1)
    return wrong.orderBy(F.col(score).desc(), F.col(doc)).limit(n)


def error_analysis(
    decisions: DataFrame,
    label: str,
    features: Sequence[str],
) -> DataFrame:
    """Feature distributions of wrong and right accepted decisions."""
    return feature_describe(accepted_errors(decisions, label), features, ["is_error"])
