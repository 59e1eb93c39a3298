"""Training, scoring and comparison of pair classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termbridge.operators.metrics import classification_metrics, roc_auc
from termbridge.operators.pairs import hashed_uniform, threshold_label
from termbridge.operators.ranking import ranking_report
from termbridge.operators.skew import number_rows, running_sums
from termbridge.schemas import PairSpec
from termbridge.session import cut_lineage, shuffle_width

SEED = 7
ROWS_PER_CELL = 4  # from which trees learn from counted cells
CELLS_PER_TASK = 50_000
TREES_AT_ONCE = 8
TREES_PER_STEP = 25


def assemble_scale(spec: PairSpec, scaled: bool = True) -> list:
    """Stages that build the ``features`` vector, standardised by mean and sample deviation."""
    raw = "features_raw" if scaled else "features"
    stages = [VectorAssembler(inputCols=list(spec.features), outputCol=raw)]
    if scaled:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    return stages


def _columns(spec: PairSpec, weight: str | None) -> dict:
    names = {"featuresCol": "features", "labelCol": spec.label}
    return {**names, "weightCol": weight} if weight else names


# --------------------------------------------------------------------------
# Trees on counted cells: a tree sees features in at most maxBins bins, so rows with the same bins and label are one row
# with a count.


def _bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Where the bins of every feature begin: at each value where there are at most ``bins``, else at quantiles."""
    about = rows.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    few = [f for f in features if about[f] <= 2 * bins]
    values = rows.agg(F.lit(0), *[F.collect_set(f).alias(f) for f in few]).first()
    begins = {f: values[f] for f in few if len(values[f]) <= bins}
    many = [f for f in features if f not in begins]
    quantiles = rows.approxQuantile(many, [i / bins for i in range(bins)], 0.001) if many else []
    begins |= dict(zip(many, quantiles))
    # A feature of one value has its bin begin there; edges need one number at least.
    starts = [sorted(set(begins[f])) for f in features]
    return [[float("-inf"), *(s[1:] or s), float("inf")] for s in starts]


def _drawn(columns: Sequence[str], trees: int, seed: int):
    """Rows (columns, n, key) with ``trees`` draws of how often a bootstrap sample has the n rows of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = batch.column("n").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            draws = [np.random.default_rng([seed, int(k)]).poisson(rows, trees) for k, rows in zip(keys, n)]
            bags = np.array(draws, dtype=np.int64).reshape(len(n), trees).T
            kept = [batch.column(c) for c in columns]
            names = [*columns, *(f"bag_{i}" for i in range(trees))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(bag) for bag in bags)], names)

    return run


class BaggedForest(Model):
    """Single trees whose class shares are averaged, as a random forest does; every different cell is scored once."""

    def __init__(self, trees: Sequence[Model], cells: Sequence[str]):
        super().__init__()
        self.trees, self.cells = list(trees), list(cells)

    @property
    def featureImportances(self) -> DenseVector:
        total = sum(tree.featureImportances.toArray() for tree in self.trees)
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        named = [F.col(c).alias(f"__{c}") for c in self.cells]
        keys = [f"__{c}" for c in self.cells]
        wanted = dataset.select(*named).distinct()
        scored = VectorAssembler(inputCols=keys, outputCol="__bins").transform(cut_lineage(wanted))
        scored = scored.withColumn("__votes", F.lit(0.0))
        for at in range(0, len(self.trees), TREES_PER_STEP):
            votes = []
            for i, tree in enumerate(self.trees[at : at + TREES_PER_STEP]):
                alone = tree.copy().setFeaturesCol("__bins").setProbabilityCol(f"__p{i}")
                scored = alone.setPredictionCol("").setRawPredictionCol("").transform(scored)
                votes.append(vector_to_array(f"__p{i}")[1])
            scored = scored.select(*keys, "__bins", (F.col("__votes") + reduce(add, votes)).alias("__votes"))
        scored = cut_lineage(scored.drop("__bins"))
        size = float(len(self.trees))
        share = F.col("__votes") / size
        matched = [F.col(c) == F.col(k) for c, k in zip(self.cells, keys)]
        return dataset.join(scored, reduce(lambda a, b: a & b, matched)).select(
            *dataset.columns,
            array_to_vector(F.array(size - F.col("__votes"), "__votes")).alias("rawPrediction"),
            array_to_vector(F.array(1.0 - share, share)).alias("probability"),
            (share > 0.5).cast("double").alias("prediction"),
        )


class CountedTrees(Estimator):
    """Fits a tree classifier on counted cells where rows repeat in them, else on the rows.

    The classifier's own split search has no more than ``maxBins`` bins a feature either. Boosting weighs a cell by its
    count. A forest draws for every tree how often a bootstrap sample of the rows would have the cell: a sum of n
    Poisson draws of mean 1 is one of mean n. What counts cannot say is fitted on rows: rows sampled without replacement,
    and a least number of instances of unequal weights.
    """

    def __init__(self, classifier: RandomForestClassifier | GBTClassifier, features: Sequence[str]):
        super().__init__()
        self.classifier, self.features = classifier, list(features)

    def copy(self, extra: dict | None = None) -> CountedTrees:
        return CountedTrees(self.classifier.copy(extra), self.features)

    def _counts(self, dataset: DataFrame) -> tuple[Bucketizer, DataFrame, list[str], int, float] | None:
        """The bins, cells with their counts, what names a cell, tasks, least share of the weight a node has; None for rows."""
        tree = self.classifier
        weight = [tree.getWeightCol()] if tree.isDefined(tree.weightCol) else []
        if tree.getSubsamplingRate() < 1.0 or (weight and tree.getMinInstancesPerNode() > 1):
            return None
        if isinstance(tree, RandomForestClassifier) and not tree.getBootstrap():
            return None
        rows = dataset.select(*self.features, tree.getLabelCol(), *weight)
        edges = _bin_edges(rows, self.features, tree.getMaxBins())
        bins = [f"{f}__bin" for f in self.features]
        dealt = Bucketizer(splitsArray=edges, inputCols=self.features, outputCols=bins)
        keys = [*bins, tree.getLabelCol(), *weight]
        # Without the bucketizer's metadata, by which trees would take bins for categories without order.
        ordered = dealt.transform(rows).withColumns({b: F.col(b).alias(b, metadata={}) for b in bins})
        counts = cut_lineage(ordered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        size = counts.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")).first()
        if size["cells"] * ROWS_PER_CELL > (size["rows"] or 0):
            return None
        weighed = reduce(lambda a, b: a * b, [F.col(c) for c in weight], F.lit(1.0))
        least = (tree.getMinInstancesPerNode() - 0.5) / size["rows"] if tree.getMinInstancesPerNode() > 1 else 0.0
        parts = max(1, -(-size["cells"] // CELLS_PER_TASK))
        return dealt, counts.withColumn("__unit", weighed), keys, parts, least

    def _fit(self, dataset: DataFrame) -> Model:
        tree, found = self.classifier, self._counts(dataset)
        if found is None:
            return tree.fit(dataset)
        dealt, counts, keys, parts, least = found
        bins = dealt.getOutputCols()
        assembler = VectorAssembler(inputCols=bins, outputCol="bins")
        alone = tree.copy().setFeaturesCol("bins").setWeightCol("__weight")
        alone = alone.setMinInstancesPerNode(1).setMinWeightFractionPerNode(max(least, tree.getMinWeightFractionPerNode()))
        if isinstance(tree, GBTClassifier):
            weighed = counts.withColumn("__weight", F.col("n") * F.col("__unit")).repartition(parts, *keys)
            model = alone.fit(assembler.transform(weighed))
            return PipelineModel([dealt, assembler, model])
        trees, seed = tree.getNumTrees(), tree.getSeed()
        names = [*keys, "__unit"]
        schema = ", ".join([*(f"`{c}` {t}" for c, t in counts.dtypes if c in names), *(f"bag_{i} bigint" for i in range(trees))])
        ordered = [c for c in counts.columns if c in names]
        keyed = counts.withColumn("key", F.xxhash64(*keys)).repartition(shuffle_width(dataset), *keys)
        bags = cut_lineage(keyed.mapInArrow(_drawn(ordered, trees, seed % (1 << 63)), schema).repartition(parts, *keys))
        strategy = tree.getFeatureSubsetStrategy()
        alone = alone.setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy("sqrt" if strategy == "auto" and trees > 1 else strategy)

        def fit(i: int) -> Model:
            bag = bags.where(F.col(f"bag_{i}") > 0).withColumn("__weight", F.col(f"bag_{i}") * F.col("__unit"))
            return alone.copy().setSeed(seed + i).fit(assembler.transform(bag))

        with ThreadPool(min(TREES_AT_ONCE, trees)) as pool:
            fitted = pool.map(inheritable_thread_target(dataset.sparkSession)(fit), range(trees), 1)
        return PipelineModel([dealt, BaggedForest(fitted, bins)])


# The settings searched, by grid and model.
GRIDS = {
    "full": {
        "logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
        "random_forest": {"numTrees": [50, 200], "maxDepth": [5, 10]},
        "gbt": {"maxDepth": [3, 5]},
    },
    "wide": {
        "logistic": {"C": [0.01, 0.1, 1.0, 10.0]},
        "random_forest": {
            "numTrees": [50, 100, 200],
            "maxDepth": [5, 10, 15],
            "minInstancesPerNode": [1, 2],
        },
        "gbt": {
            "maxIter": [50, 100],
            "stepSize": [0.05, 0.1],
            "maxDepth": [3, 5],
            "subsamplingRate": [0.8, 1.0],
        },
    },
    "none": {"logistic": {}, "random_forest": {}, "gbt": {}},
}


def build_models(
    spec: PairSpec,
    grid: str | Mapping[str, Mapping[str, Sequence]] = "full",
    n_rows: int | None = None,
    weight: str | None = None,
    seed: int = SEED,
) -> dict[str, tuple[Pipeline, list]]:
    """Pipelines and parameter maps by model name.

    The wide grid gives the strength C of logistic regression; it becomes
    regParam = 1 / (C * n_rows) and needs ``n_rows``. Its trees are not scaled.
    """
    grids = GRIDS[grid] if isinstance(grid, str) else grid
    columns = _columns(spec, weight)
    classifiers = {
        "logistic": LogisticRegression(**columns),
        "random_forest": RandomForestClassifier(seed=seed, **columns),
        "gbt": GBTClassifier(maxIter=60, stepSize=0.05, seed=seed, **columns),
    }
    models = {}
    for name, values in grids.items():
        classifier = classifiers[name]
        builder = ParamGridBuilder()
        for parameter, options in values.items():
            if parameter == "C":
                if not n_rows:
                    raise ValueError("the C grid needs n_rows")
                parameter, options = "regParam", [1.0 / (c * n_rows) for c in options]
            builder = builder.addGrid(classifier.getParam(parameter), list(options))
        scaled = name == "logistic" or grid != "wide"
        last = classifier if name == "logistic" else CountedTrees(classifier, spec.features)
        models[name] = (Pipeline(stages=[*assemble_scale(spec, scaled), last]), builder.build())
    return models


def cross_validate(
    train: DataFrame,
    models: Mapping[str, tuple[Pipeline, list]],
    spec: PairSpec,
    folds: int = 4,
    fold_col: str | None = None,
    parallelism: int = 4,
    seed: int = SEED,
) -> dict[str, CrossValidatorModel]:
    """Fit every model with the settings of the best mean AUC.

    With ``fold_col`` (0 .. folds-1) the given folds are used, so that a query
    need not be on both sides.
    """
    auc = BinaryClassificationEvaluator(
        labelCol=spec.label, rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0
    )
    fitted = {}
    for name, (pipeline, grid) in models.items():
        validator = CrossValidator(
            estimator=pipeline,
            estimatorParamMaps=grid,
            evaluator=auc,
            numFolds=folds,
            parallelism=parallelism,
            seed=seed,
            **({"foldCol": fold_col} if fold_col else {}),
        )
        prepared = {stage.uid for stage in pipeline.getStages()[:-1]}
        if fold_col is None or any(p.parent in prepared for settings in grid for p in settings):
            fitted[name] = validator.fit(train)
            continue
        aucs = [_fold_aucs(train, fold_col, i, pipeline, grid, spec, parallelism) for i in range(folds)]
        means = [float(m) for m in np.mean(aucs, axis=0)]
        best = pipeline.fit(train, grid[int(np.argmax(means))])
        model = CrossValidatorModel(best, means, None, [float(d) for d in np.std(aucs, axis=0)])
        for param in (model.estimator, model.estimatorParamMaps, model.evaluator, model.numFolds, model.seed, model.foldCol):
            model.set(param, validator.getOrDefault(param.name))
        fitted[name] = model
    return fitted


def _fold_aucs(
    rows: DataFrame, fold_col: str, fold: int, pipeline: Pipeline, grid: list, spec: PairSpec, parallelism: int
) -> list[float]:
    """AUC of every setting on one fold: the stages before the classifier are fitted and applied once for all settings,
    and one pass scores the fold under all of them."""
    *before, classifier = pipeline.getStages()
    train, validation = rows.where(F.col(fold_col) != fold), rows.where(F.col(fold_col) == fold)
    if train.isEmpty() or validation.isEmpty():
        raise ValueError(f"fold {fold} has no rows on one of its sides")
    inner = getattr(classifier, "classifier", classifier)
    weight = [inner.getWeightCol()] if inner.isDefined(inner.weightCol) else []
    needed = list(dict.fromkeys([*spec.features, spec.label, *weight]))
    ready = Pipeline(stages=before).fit(train.select(*needed))
    with_features = [*needed, inner.getFeaturesCol()]
    learned = ready.transform(train.select(*needed)).select(*with_features).persist()
    try:
        with ThreadPool(min(parallelism, len(grid))) as pool:
            fit = inheritable_thread_target(rows.sparkSession)(lambda settings: classifier.fit(learned, settings))
            made = pool.map(fit, grid, 1)
    finally:
        learned.unpersist()
    scored = ready.transform(validation.select(*needed)).select(*with_features)
    scores = []
    for i, model in enumerate(made):
        kept = scored.columns
        scored = model.transform(scored).select(*kept, vector_to_array("rawPrediction")[1].alias(f"__score{i}"))
        scores.append(F.struct(F.lit(i).alias("setting"), F.col(f"__score{i}").alias("score")))
    listed = scored.select(spec.label, F.explode(F.array(*scores)).alias("s")).select(spec.label, "s.*")
    found = {r.setting: r.auc for r in roc_auc(cut_lineage(listed), spec.label, "score", ["setting"]).collect()}
    return [float("nan") if found.get(i) is None else float(found[i]) for i in range(len(grid))]


def cross_validation_table(spark: SparkSession, fitted: Mapping[str, CrossValidatorModel]) -> DataFrame:
    """Mean AUC of every setting tried."""
    rows = [
        (name, i, ", ".join(sorted(f"{p.name}={v}" for p, v in settings.items())), float(auc))
        for name, model in fitted.items()
        for i, (settings, auc) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics))
    ]
    return spark.createDataFrame(rows, "model string, setting int, params string, mean_auc double")


def score_pairs(model: Transformer, df: DataFrame, name: str = "score") -> DataFrame:
    """Add the probability of class 1."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def evaluate(scored: DataFrame, spec: PairSpec, model: str, threshold: float = 0.5) -> DataFrame:
    """One row of classification and ranking measures of a scored table."""
    needed = scored.select(spec.query, spec.doc, spec.label, "score")
    needed = cut_lineage(needed).withColumn("model", F.lit(model))
    labelled = threshold_label(needed, "score", threshold)
    ranking = ranking_report(needed, spec.query, "score", spec.doc, spec.label)
    return (
        classification_metrics(labelled, spec.label, "pred", ["model"])
        .join(roc_auc(needed, spec.label, "score", ["model"]), "model")
        .join(ranking.withColumn("model", F.lit(model)), "model")
    )


def feature_importance(spark: SparkSession, model, spec: PairSpec) -> DataFrame:
    """Importance of every feature, or its coefficient, largest first."""
    if isinstance(model, CrossValidatorModel):
        model = model.bestModel
    last = model
    while isinstance(last, PipelineModel):
        last = last.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = sorted(zip(spec.features, map(float, values.toArray())), key=lambda r: -abs(r[1]))
    return spark.createDataFrame(
        [(i, f, v) for i, (f, v) in enumerate(rows, start=1)],
        "position int, feature string, importance double",
    )


def model_comparison(rows: Sequence[DataFrame], digits: int = 4) -> DataFrame:
    """All models' measures, rounded. F1 here is that of the test rows it is measured on."""
    table = rows[0]
    for other in rows[1:]:
        table = table.unionByName(other)
    doubles = [n for n, t in table.dtypes if t == "double"]
    return table.withColumns({n: F.round(n, digits) for n in doubles})


def best_model(comparison: DataFrame) -> DataFrame:
    """The row with the highest F1; the first name among equals."""
    return comparison.orderBy(F.col("f1").desc(), "model").limit(1)


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add rows / (2 * rows of the class), for ``weightCol``."""
    positive = (F.col(label) == 1).cast("long")
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(positive).alias("p"))
    n, p = counts.select("n").scalar(), counts.select("p").scalar()
    size = F.when(F.col(label) == 1, p).otherwise(n - p)
    return df.withColumn(name, F.try_divide(n.cast("double"), F.lit(2.0) * size))


def downsample_negatives(df: DataFrame, label: str, key: Sequence[str], ratio: float) -> DataFrame:
    """All positives and about ``ratio`` negatives for each; the choice follows the key's digest."""
    positive = (F.col(label) == 1).cast("long")
    counts = df.agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("n"))
    share = F.try_divide(
        counts.select("p").scalar() * F.lit(float(ratio)), counts.select("n").scalar()
    )
    draw = hashed_uniform(*[F.col(c).cast("string") for c in key])
    return df.filter((F.col(label) == 1) | (draw < share))


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (lo, hi, positives, n) of rising share from sorted blocks: neighbours that do not rise are pooled."""
    done: list[list[float]] = []
    for batch in batches:
        for block in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "positives", "n"))):
            now = list(block)
            while done and done[-1][2] * now[3] >= now[2] * done[-1][3]:
                low, _, positives, n = done.pop()
                now = [low, now[1], now[2] + positives, now[3] + n]
            done.append(now)
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*done)], ["lo", "hi", "positives", "n"])


class IsotonicFit:
    """A monotone map from score to probability: blocks of scores with one value each."""

    def __init__(self, blocks: DataFrame, score: str):
        self.blocks, self.score = blocks, score

    def transform(self, df: DataFrame, name: str = "calibrated") -> DataFrame:
        """Add the block's value; between two blocks a straight line, beyond the ends the end's value.

        Rows and blocks meet by the number of blocks that begin at or below a score, counted over sorted
        slices. A null score has a null value.
        """
        share = F.col("positives") / F.col("n")
        numbered = cut_lineage(number_rows(self.blocks.select("lo", "hi", share.alias("value")), [], [F.col("lo")], "at"))
        following = numbered.select((F.col("at") - 1).alias("at"), F.col("lo").alias("next_lo"), F.col("value").alias("next_value"))
        steps = numbered.join(following, "at", "left").select(F.col("at").alias("__at"), "hi", "value", "next_lo", "next_value")
        rows = df.withColumns({"__x": F.col(self.score).cast("double"), "__edge": F.lit(0)})
        edges = self.blocks.select(F.col("lo").alias("__x"), F.lit(1).alias("__edge"))
        both = rows.unionByName(edges, allowMissingColumns=True)
        placed = running_sums(both, [], [F.col("__x").asc(), F.col("__edge").desc()], {"__at": F.col("__edge")})
        placed = placed.where("__edge = 0").withColumn("__at", F.greatest("__at", F.lit(1)).cast("int"))
        x, hi, value = F.col("__x"), F.col("hi"), F.col("value")
        line = value + (F.col("next_value") - value) * (x - hi) / (F.col("next_lo") - hi)
        found = F.when((x <= hi) | F.col("next_lo").isNull(), value).otherwise(line)
        return placed.join(steps, "__at", "left").select(*df.columns, F.when(x.isNotNull(), found).alias(name))


def fit_isotonic(scored: DataFrame, label: str, score: str = "score") -> IsotonicFit:
    """Monotone map from score to probability by pooling adjacent violators, on the scores as they are.

    Equal scores are one point. Sorted slices pool their own points in tasks; the blocks that remain are pooled
    once more, in one task. They are few whatever the scores: blocks of 0/1 labels have rising shares, and n
    rows have room for no more than about n^(2/3) different ones. Rows without score or label say nothing;
    scores must lie in [0, 1].
    """
    given = F.col(score).cast("double")
    refused = F.raise_error(F.lit("scores must lie in [0, 1]"))
    kept = F.when((given < 0) | (given > 1), refused).otherwise(given)
    points = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(kept.alias("lo")).agg(
        F.sum(F.col(label).cast("double")).alias("positives"), F.count(F.lit(1)).cast("double").alias("n")
    )
    points = points.select("lo", F.col("lo").alias("hi"), "positives", "n")
    schema = "lo double, hi double, positives double, n double"
    sliced = points.repartitionByRange(shuffle_width(scored), "lo").sortWithinPartitions("lo")
    parts = cut_lineage(sliced.mapInArrow(_pooled, schema))
    whole = parts.repartition(1).sortWithinPartitions("lo").mapInArrow(_pooled, schema)
    return IsotonicFit(cut_lineage(whole), score)


def most_uncertain(scored: DataFrame, order: Sequence[str | Column], n: int, score: str = "score") -> DataFrame:
    """The n pairs whose score is nearest to 0.5, for review."""
    return scored.orderBy(F.abs(F.col(score) - 0.5), *order).limit(n)
