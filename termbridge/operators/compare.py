"""Comparison of two result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.functions.text import strip
from termbridge.schemas import CONFIDENCE_LEVELS

COMPARED = ["icd9_name", "selected_code", "selected_name", "confidence"]


def compare_join(
    first: DataFrame, second: DataFrame, on: str = "icd9_code", suffixes=("_baseline", "_synonym")
) -> DataFrame:
    """Inner join of two runs on the trimmed code, columns marked by run.

    Equal rows of a run are counted before the join, so copies of a code are not
    paired one by one; ``n_pairs`` says how many pairs of input rows a row stands for.
    """

    def side(df: DataFrame, suffix: str) -> DataFrame:
        others = [c for c in COMPARED if c in df.columns]
        rows = df.select(strip(F.col(on)).alias(on), *[F.col(c).alias(c + suffix) for c in others])
        return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(f"n{suffix}"))

    a, b = suffixes
    joined = side(first, a).join(side(second, b), on)
    return joined.withColumn("n_pairs", F.col(f"n{a}") * F.col(f"n{b}")).drop(f"n{a}", f"n{b}")


def confidence_order(confidence: Column) -> Column:
    """strong 3, medium 2, weak 1, anything else 0."""
    top = len(CONFIDENCE_LEVELS) - 1
    scored = F.when(confidence == CONFIDENCE_LEVELS[0], F.lit(top))
    for i, level in enumerate(CONFIDENCE_LEVELS[1:], start=1):
        scored = scored.when(confidence == level, F.lit(top - i))
    return F.coalesce(scored, F.lit(0))


def compare_diff(joined: DataFrame, suffixes=("_baseline", "_synonym")) -> DataFrame:
    """Rows with different selected codes and whether confidence rose or fell. Two nulls agree."""
    a, b = suffixes
    rose = confidence_order(F.col(f"confidence{b}")) - confidence_order(F.col(f"confidence{a}"))
    change = F.when(rose > 0, "improvement").when(rose < 0, "regression").otherwise("same")
    differs = ~F.col(f"selected_code{a}").eqNullSafe(F.col(f"selected_code{b}"))
    return joined.filter(differs).withColumn("change", change)


def compare_summary(joined: DataFrame, suffixes=("_baseline", "_synonym")) -> DataFrame:
    """Counts of the differences and their share of the joined rows, null if there are none."""
    a, b = suffixes
    differs = ~F.col(f"selected_code{a}").eqNullSafe(F.col(f"selected_code{b}"))
    rose = confidence_order(F.col(f"confidence{b}")) - confidence_order(F.col(f"confidence{a}"))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n_pairs"))), F.lit(0))

    counts = joined.agg(
        count(F.lit(True)).alias("n_joined"),
        count(differs).alias("n_different"),
        count(differs & (rose > 0)).alias("n_improvement"),
        count(differs & (rose < 0)).alias("n_regression"),
        count(differs & (rose == 0)).alias("n_same_confidence"),
    )
    share = F.try_divide(F.lit(100.0) * F.col("n_different"), F.col("n_joined"))
    return counts.withColumn("percent_different", share)


def confidence_distribution(joined: DataFrame, suffixes=("_baseline", "_synonym")) -> DataFrame:
    """Rows per run and confidence, most frequent first; rows without one are left out."""
    runs = F.array(
        *[
            F.struct(F.lit(s.lstrip("_")).alias("run"), F.col(f"confidence{s}").alias("confidence"))
            for s in suffixes
        ]
    )
    rows = joined.select(F.explode(runs).alias("r"), "n_pairs").select("r.*", "n_pairs")
    counted = rows.filter(F.col("confidence").isNotNull()).groupBy("run", "confidence")
    return counted.agg(F.sum("n_pairs").alias("n")).orderBy("run", F.col("n").desc(), "confidence")


def case_check(
    joined: DataFrame, code: str, expected: str, on: str = "icd9_code", suffixes=("_baseline", "_synonym")
) -> DataFrame:
    """The outcome for one code: found_by_second, already_in_first, neither or not_in_set."""
    a, b = suffixes
    second = F.coalesce(F.col(f"selected_code{b}") == expected, F.lit(False))
    first = F.coalesce(F.col(f"selected_code{a}") == expected, F.lit(False))
    outcome = F.when(second, 1).when(first, 2).otherwise(3)
    # The first row of a code decides; the lowest outcome among equal codes.
    found = joined.filter(F.col(on) == code).agg(F.min(outcome).alias("outcome"))
    names = {1: "found_by_second", 2: "already_in_first", 3: "neither"}
    label = F.lit("not_in_set")
    for number, name in names.items():
        label = F.when(F.col("outcome") == number, name).otherwise(label)
    return found.select(F.lit(code).alias(on), F.lit(expected).alias("expected"), label.alias("outcome"))


def multi_map_filter(results: DataFrame) -> DataFrame:
    """Selections of terms that join several concepts, with their broad and exact codes."""
    return results.filter("is_multi_map").select(
        "icd9_code",
        "icd9_name",
        "selected_code",
        "more_broad_icd10_code",
        "more_broad_icd10_name",
        "closest_exact_icd10_code",
        "closest_exact_icd10_name",
    )
