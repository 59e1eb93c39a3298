"""Classification measures as small result tables, optionally one row per ``by`` value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termbridge.operators.skew import range_slices


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def confusion_matrix(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    def cell(y: int, p: int) -> Column:
        both = (F.col(label) == y) & (F.col(pred) == p)
        return F.coalesce(F.sum(both.cast("long")), F.lit(0))

    return df.groupBy(*by).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def classification_metrics(
    df: DataFrame, label: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and NPV of the positive class."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_matrix(df, label, pred, by).select(
        *by,
        "tn",
        "fp",
        "fn",
        "tp",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        _ratio(tp, tp + fn).alias("sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(tp, tp + fp).alias("ppv"),
        _ratio(tn, tn + fn).alias("npv"),
    )


def weighted_f1(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, and F1 of both classes averaged by their share of the labels."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tp + tn + fp + fn
    both = _f1(tp, fp, fn) * (tp + fn) + _f1(tn, fn, fp) * (tn + fp)
    return confusion_matrix(df, label, pred, by).select(
        *by, _ratio(tp + tn, n).alias("accuracy"), _ratio(both, n).alias("weighted_f1")
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; ties count half, one class only gives null.

    Rows are first reduced to one per score. The scores are range partitioned,
    each slice sums its own share, and only the slice totals meet in one place.
    """
    by = list(by)
    per_score = df.groupBy(*by, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"),
    )
    sliced = range_slices(per_score, [*by, F.col(score).desc()])
    above = (
        Window.partitionBy("slice", *by)
        .orderBy(F.col(score).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.withColumn("pos_above", F.coalesce(F.sum("pos").over(above), F.lit(0)))
    totals = local.groupBy("slice", *by).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)).alias("area"),
    )
    # One row per slice and ``by`` value, so a single window partition is small.
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifted = totals.withColumn("pos_before", F.coalesce(F.sum("pos").over(earlier), F.lit(0)))
    return shifted.groupBy(*by).agg(
        F.try_divide(
            F.sum(F.col("area") + F.col("neg") * F.col("pos_before")),
            F.sum("pos").cast("double") * F.sum("neg"),
        ).alias("auc")
    )


def default_grid(first: int = 10, last: int = 94, step: int = 2) -> list[float]:
    """Thresholds 0.10, 0.12, ... 0.94; ``last=90`` gives the shorter grid."""
    return [i / 100 for i in range(first, last + 1, step)]


def _steps_reached(score: Column, grid: Sequence[float], below: int = 0) -> Column:
    """How many thresholds of the sorted grid ``score`` reaches, by halving the grid."""
    if not grid:
        return F.lit(below)
    middle = len(grid) // 2
    return F.when(
        score >= F.lit(grid[middle]), _steps_reached(score, grid[middle + 1 :], below + middle + 1)
    ).otherwise(_steps_reached(score, grid[:middle], below))


def threshold_sweep(
    df: DataFrame,
    label: str,
    score: str,
    grid: Sequence[float] | None = None,
    single_class_zero: bool = True,
) -> DataFrame:
    """Binary and weighted measures at every threshold, from one pass over the pairs.

    Each pair is counted under the number of thresholds its score reaches; the
    counts at a threshold are sums over the few counters above it. With
    ``single_class_zero``, a threshold at which all predictions agree has F1,
    precision and recall 0.
    """
    grid = sorted(grid or default_grid())
    reached = _steps_reached(F.col(score), grid)
    counts = (
        df.filter(F.col(score).isNotNull())
        .groupBy(reached.alias("reached"))
        .agg(
            F.sum((F.col(label) == 1).cast("long")).alias("pos"),
            F.sum((F.col(label) != 1).cast("long")).alias("neg"),
        )
    )
    spark = df.sparkSession
    # Fixed size: one row per threshold, and one for scores below them all.
    points = spark.createDataFrame(
        [(i, t) for i, t in enumerate([None, *grid])], "reached int, threshold double"
    )
    at_least = Window.partitionBy(F.lit(0)).orderBy(F.col("reached").desc())
    everything = Window.partitionBy(F.lit(0))
    zero = F.lit(0).cast("long")
    filled = points.join(F.broadcast(counts), "reached", "left").select(
        "reached", "threshold", F.coalesce("pos", zero).alias("pos"), F.coalesce("neg", zero).alias("neg")
    )
    cells = filled.select(
        "threshold",
        F.sum("pos").over(at_least).alias("tp"),
        F.sum("neg").over(at_least).alias("fp"),
        F.sum("pos").over(everything).alias("p"),
        F.sum("neg").over(everything).alias("n"),
    ).filter(F.col("threshold").isNotNull())
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("p") - tp, F.col("n") - fp
    same = ((tp + fp) == 0) | ((tn + fn) == 0) if single_class_zero else F.lit(False)

    def unless_same(value: Column) -> Column:
        return F.when(same, F.lit(0.0)).otherwise(value)

    size = F.col("p") + F.col("n")
    return cells.select(
        "threshold",
        unless_same(_f1(tp, fp, fn)).alias("f1"),
        _ratio(tp + tn, size).alias("accuracy"),
        unless_same(_ratio(tp, tp + fp)).alias("precision"),
        unless_same(_ratio(tp, F.col("p"))).alias("recall"),
        _ratio(_f1(tp, fp, fn) * F.col("p") + _f1(tn, fn, fp) * F.col("n"), size).alias(
            "weighted_f1"
        ),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the highest F1; the lowest threshold among equals."""
    return sweep.orderBy(F.col("f1").desc(), "threshold").limit(1)


def coverage(decisions: DataFrame, label: str, empty: float | None = 0.0) -> DataFrame:
    """Share of queries accepted and accuracy among them (``empty`` if there are none)."""
    accepted = F.col("accept") == 1
    right = F.avg(F.when(accepted, F.col(label).cast("double")))
    return decisions.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.sum(accepted.cast("long")), F.lit(0)).alias("n_accepted"),
        F.coalesce(F.sum((~accepted).cast("long")), F.lit(0)).alias("n_rejected"),
        F.avg(F.col("accept").cast("double")).alias("coverage"),
        (right if empty is None else F.coalesce(right, F.lit(empty))).alias("accuracy_on_accepted"),
    )
