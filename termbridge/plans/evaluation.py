"""End-to-end evaluation of a labelled pair table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termbridge.operators import metrics, models, pairs, profile, ranking
from termbridge.schemas import PairSpec
from termbridge.session import cut_lineage


@dataclass(frozen=True)
class Evaluation:
    """Tables of one evaluation run."""

    comparison: DataFrame
    best: DataFrame
    sweep: DataFrame
    decisions: DataFrame
    coverage: DataFrame
    errors: DataFrame
    predictions: DataFrame


def evaluate_pairs(
    df: DataFrame,
    spec: PairSpec,
    grid: str | Mapping[str, Mapping[str, Sequence]] = "full",
    folds: int = 4,
    parallelism: int = 4,
) -> Evaluation:
    """Clean, split by query, train, compare, choose a threshold on the training side,
    and decide one candidate per test query. Cross-validation folds also follow the query."""
    clean = cut_lineage(pairs.group_fold(pairs.clean_pairs(df, spec), spec.query))
    train, test = pairs.train_test(clean)
    inner = train.withColumn("cv_fold", F.pmod(F.xxhash64(spec.query), F.lit(folds)).cast("int"))
    built = models.build_models(spec, grid, n_rows=train.count())
    fitted = models.cross_validate(inner, built, spec, folds, "cv_fold", parallelism)
    scored = {"baseline": pairs.equal_weight_score(test, spec.features)}
    scored |= {name: models.score_pairs(m, test) for name, m in fitted.items()}
    comparison = cut_lineage(
        models.model_comparison([models.evaluate(s, spec, name) for name, s in scored.items()])
    )
    best = models.best_model(comparison)
    name = best.first()["model"]
    if name == "baseline":
        trained = pairs.equal_weight_score(train, spec.features)
        sweep, threshold = metrics.threshold_sweep(trained, spec.label, "score"), 0.5
    else:
        trained = models.score_pairs(fitted[name], train)
        sweep = cut_lineage(metrics.threshold_sweep(trained, spec.label, "score"))
        threshold = metrics.best_threshold(sweep).first()["threshold"]
    predictions = cut_lineage(scored[name])
    decisions = ranking.decide(predictions, spec.query, "score", spec.doc, threshold)
    return Evaluation(
        comparison,
        best,
        sweep,
        decisions,
        metrics.coverage(decisions, spec.label),
        profile.error_analysis(decisions, spec.label, spec.features),
        predictions,
    )
