import json

import pytest
from pyspark.sql import functions as F

from termbridge.operators import models, pairs
from termbridge.operators.vectors import embed_text
from termbridge.plans.evaluation import evaluate_pairs
from termbridge.plans.mapping import embed_universe
from termbridge.schemas import PairSpec
from termbridge.sources import readers, writers


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_universe_csv(spark, tmp_path):
    path = write(
        tmp_path,
        "u.csv",
        'code,name,synonyms,description\n 0398 ,"A, ""b"" ",x| y ||,\nB,old,,d\nB,new,z,\n099,,,\n',
    )
    rows = {r.code: r for r in readers.read_universe_csv(spark, path).collect()}
    assert rows["0398"].name == 'A, "b"' and rows["0398"].synonyms == ["x", "y"]
    assert (rows["B"].name, rows["B"].synonyms, rows["B"].n_rows) == ("new", ["z"], 2)
    assert rows["099"].name == "" and rows["099"].synonyms == [] and rows["099"].description is None
    with pytest.raises(ValueError):
        readers.read_universe_csv(spark, path, code_col="nothing")


def test_multi_line_cells(spark, tmp_path):
    path = write(tmp_path, "m.csv", 'code,name\nA,"two\nlines"\n')
    assert readers.read_universe_csv(spark, path, multi_line=True).first().name == "two\nlines"


def test_universe_tsv(spark, tmp_path):
    path = write(tmp_path, "u.tsv", "icd10_phe\ticd10_code\nname one\t001\n")
    row = readers.read_universe_tsv(spark, path).first()
    assert (row.code, row.name, row.synonyms) == ("001", "name one", [])


def test_records(spark, tmp_path):
    path = write(tmp_path, "r.csv", "icd9_code,icd9_name,icd10_direct_candidates,direct\n099 , n ,C9,C1:x|C2\n7,m,,\n")
    rows = {r.code: r for r in readers.read_records_csv(spark, path).collect()}
    assert rows["099"].name == "n" and [tuple(c) for c in rows["099"].direct_candidates] == [("C1", "x"), ("C2", None)]
    assert rows["7"].direct_candidates == [] and rows["7"].record_id != rows["099"].record_id
    with pytest.raises(ValueError):
        readers.read_records_csv(spark, write(tmp_path, "bad.csv", "icd9_code,x\n1,2\n"))
    path = write(
        tmp_path,
        "r.tsv",
        "icd9_code\ticd9_phe\tpotential_matches\n099\ta\tICD10_code:A64:phenoname:s\n010\tb\t\n011\tc\t\n",
    )
    rows = readers.read_records_tsv(spark, path, limit=2).collect()
    assert sorted(r.code for r in rows) == ["010", "099"]


def test_results_round_trip(spark, tmp_path):
    path = write(
        tmp_path,
        "old.jsonl",
        json.dumps(
            {
                "input": {"icd9_code": "034", "icd9_name": "n", "direct_candidates": []},
                "selected_code": "A1",
                "confidence": "strong",
                "mapping_category": "CLOSE_MATCH",
                "allowed_candidates": [{"code": "A1", "name": "x", "source": "retrieved", "score": 0.5}],
                "retrieved_top_k": 1,
                "num_attempts": 1,
                "salvage_strategy": None,
            }
        ),
    )
    old = readers.read_results_jsonl(spark, path)
    assert old.first().is_multi_map is None and old.first().input.icd9_code == "034"
    out = str(tmp_path / "out")
    writers.write_results_jsonl(old.withColumn("record_id", F.lit(1)), out)
    line = json.loads(spark.read.text(out).first()[0])
    assert len(line) == 21 and line["salvage_strategy"] is None and "record_id" not in line
    for profile, n in (("batch", 15), ("tsv", 18), ("demo", 13)):
        flat = str(tmp_path / profile)
        writers.write_results_csv(old, flat, profile)
        read = readers.read_result_csv(spark, flat)
        assert len(read.columns) == n
        assert (read.first().icd9_code, read.first().mapping_category) == ("034", "DIRECT_MATCH")


def test_index_is_built_once(spark, tmp_path):
    folder, built = str(tmp_path / "index"), []

    def build():
        built.append(1)
        return spark.createDataFrame(
            [("A", "n", ["s"], None, [1.0, 0.0])],
            "code string, name string, synonyms array<string>, description string, embedding array<double>",
        )

    for _ in range(2):
        universe, config = writers.build_if_missing(spark, folder, build, writers.IndexConfig(size=2))
    assert built == [1] and config.size == 2 and universe.first().embedding == [1.0, 0.0]
    with pytest.raises(ValueError, match="was built with"):
        writers.build_if_missing(spark, folder, build, writers.IndexConfig(size=3))


def test_index_keeps_its_model(spark, tmp_path):
    rows = [("A", "cold fever", None, None), ("B", "broken arm", None, None)]
    universe = spark.createDataFrame(rows, "code string, name string, synonyms array<string>, description string")
    folder, config = str(tmp_path / "index"), writers.IndexConfig(size=64)
    model, embedded = embed_universe(universe, 64)
    writers.build_if_missing(spark, folder, lambda: (embedded, model), config)
    loaded, _ = writers.build_if_missing(spark, folder, None, config)
    query = spark.createDataFrame([("arm",)], "text string")
    made = [embed_text(m, query, "text").first().vec for m in (model, writers.load_index_model(folder))]
    assert made[0] == made[1] and any(made[0]) and loaded.count() == 2


@pytest.fixture(scope="module")
def labelled(spark):
    return pairs.synthetic_pairs(spark.range(120).withColumnRenamed("id", "k"), "k").cache()


def test_read_pairs(spark, tmp_path, labelled):
    for ending in (".csv", ".parquet"):
        path = str(tmp_path / f"pairs{ending}")
        writer = labelled.write.option("header", True)
        writer.csv(path) if ending == ".csv" else writer.parquet(path)
        read = readers.read_pairs(spark, path)
        assert read.count() == labelled.count() and read.schema["correct"].dataType.simpleString() == "int"


@pytest.mark.parametrize("name", ["logistic", "random_forest", "gbt"])
def test_models_learn_the_positive(labelled, name, spark):
    spec = PairSpec()
    train, test = pairs.train_test(pairs.group_fold(labelled, spec.query))
    settings = {"logistic": {}, "random_forest": {"numTrees": [10]}, "gbt": {"maxIter": [5]}}
    pipeline, grid = models.build_models(spec, {name: settings[name]})[name]
    model = pipeline.fit(train, grid[0])
    row = models.evaluate(models.score_pairs(model, test), spec, name).first()
    assert row.auc > 0.95 and row.top1_accuracy > 0.95 and row.mrr >= row.map * 0.99
    table = models.feature_importance(spark, model, spec).collect()
    assert {r.feature for r in table} == set(spec.features)
    sizes = [abs(r.importance) for r in table]
    assert sizes == sorted(sizes, reverse=True)


def test_grids():
    spec = PairSpec()
    sizes = {n: len(g) for n, (_, g) in models.build_models(spec).items()}
    assert sizes == {"logistic": 9, "random_forest": 4, "gbt": 2}
    wide = {n: len(g) for n, (_, g) in models.build_models(spec, "wide", n_rows=100).items()}
    assert wide == {"logistic": 4, "random_forest": 18, "gbt": 16}
    with pytest.raises(ValueError):
        models.build_models(spec, "wide")


def test_whole_evaluation(labelled):
    run = evaluate_pairs(labelled, PairSpec(), {"logistic": {"regParam": [0.0, 0.1]}}, folds=2)
    assert {r.model for r in run.comparison.collect()} == {"baseline", "logistic"}
    top = run.comparison.agg(F.max("f1")).first()[0]
    assert run.best.first().f1 == top and run.sweep.count() == 43
    cover = run.coverage.first()
    assert cover.n_queries == run.predictions.select("icd9_code").distinct().count()
    assert cover.accuracy_on_accepted > 0.9


def test_codes_stay_strings_without_schema(spark, tmp_path):
    from termbridge.sources.readers import read_pairs

    (tmp_path / "pairs.csv").write_text("icd9_code,icd10_code,correct\n009,A09,1\n")
    row = read_pairs(spark, str(tmp_path / "pairs.csv")).first()
    assert (row.icd9_code, row.icd10_code, row.correct) == ("009", "A09", 1)


def test_record_keys_do_not_depend_on_files_or_splits(spark, tmp_path):
    lines = [f"{k % 40:03d},name {k % 40},A{k % 7}:x" for k in range(400)] + ['099,"two', 'lines",'] + ["010,,", "010,,"]
    head = "icd9_code,icd9_name,direct\n"
    one, many = write(tmp_path, "one.csv", head + "\n".join(lines) + "\n"), tmp_path / "many"
    many.mkdir()
    for n, part in enumerate((lines[250:], lines[:100], lines[100:250])):
        write(many, f"{n}.csv", head + "\n".join(part) + "\n")
    first = readers.read_records_csv(spark, one)
    keys = sorted((r.record_id, r.code, r.name) for r in first.collect())
    assert len(keys) == 403 == len({k[0] for k in keys}) and any(k[2] == "two\nlines" for k in keys)
    assert sorted((r.record_id, r.code, r.name) for r in readers.read_records_csv(spark, str(many)).collect()) == keys
    plain = write(tmp_path, "plain.csv", head + "\n".join(lines[:400]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        split = {r.record_id for r in readers.read_records_csv(spark, plain, multi_line=False).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == {r.record_id for r in readers.read_records_csv(spark, plain).collect()} and len(split) == 400


def test_result_csv_keeps_empty_text_apart_from_null(spark, tmp_path):
    """A candidate without a name has an empty one; a record without a match has none."""
    path = write(tmp_path, "r.csv", 'icd9_code,selected_name,rationale\n1,"",a\n2,,""\n3,"x ""y""",\n')
    rows = [tuple(r) for r in readers.read_result_csv(spark, path).orderBy("icd9_code").collect()]
    assert rows == [("1", "", "a"), ("2", None, ""), ("3", 'x "y"', None)]


@pytest.fixture(scope="module")
def repeated(spark):
    """6,000 rows in a few hundred cells, one of them in every third row."""
    spec = PairSpec(query="q", doc="d", label="label", query_name=None, doc_name=None, features=["a", "b", "c"])
    draw = [pairs.hashed_uniform(F.col("id").cast("string"), F.lit(x)) for x in "abcl"]
    rows = spark.range(6000).select(
        F.col("id").alias("q"),
        F.lit(0).alias("d"),
        *[F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.floor(u * 6) / 4.0 - 0.3).alias(f) for u, f in zip(draw, "abc")],
        draw[3].alias("u"),
    )
    likely = F.when((F.col("a") > 0.4) & (F.col("b") < 0.6), 0.8).otherwise(0.3 + 0.3 * F.col("c"))
    return spec, rows.withColumn("label", (F.col("u") < likely).cast("int")).drop("u").cache()


def _fitted_twice(repeated, name, settings):
    """Scores of the same settings learned from counted cells and from rows, side by side."""
    spec, rows = repeated
    pipeline, grid = models.build_models(spec, {name: settings})[name]
    counted = pipeline.fit(rows, grid[0])
    last = counted.stages[-1]
    assert hasattr(last, "stages"), "fitted on rows"
    plain = pipeline.copy(grid[0])
    plain.setStages([*plain.getStages()[:-1], plain.getStages()[-1].classifier])
    ours, theirs = (models.score_pairs(m, rows).select("q", "score") for m in (counted, plain.fit(rows)))
    both = ours.join(theirs.withColumnRenamed("score", "other"), "q")
    assert both.count() == 6000
    return counted, both.select(F.max(F.abs(F.col("score") - F.col("other"))), F.avg(F.abs(F.col("score") - F.col("other")))).first()


def test_boosting_on_counted_cells_is_that_on_rows(repeated):
    for settings in ({"maxIter": [8]}, {"maxIter": [4], "maxDepth": [3], "minInstancesPerNode": [40]}):
        _, (most, _) = _fitted_twice(repeated, "gbt", settings)
        assert most < 1e-6


def test_forest_on_counted_cells_draws_rows(repeated, spark):
    model, (most, mean) = _fitted_twice(repeated, "random_forest", {"numTrees": [60], "maxDepth": [4]})
    assert mean < 0.015 and most < 0.1
    rows = models.feature_importance(spark, model, repeated[0]).collect()
    assert abs(sum(r.importance for r in rows) - 1.0) < 1e-9 and len(rows) == 3
    again = _fitted_twice(repeated, "random_forest", {"numTrees": [60], "maxDepth": [4]})[0]
    assert again.stages[-1].stages[-1].featureImportances == model.stages[-1].stages[-1].featureImportances


def test_cross_validation_is_that_of_spark_with_scaling_once_a_fold(repeated, monkeypatch):
    """The same AUCs and best model as Spark's validator, with one scaler fitted a fold and one for the best."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.tuning import CrossValidator

    spec, rows = repeated
    folded = rows.withColumn("fold", (F.col("q") % 2).cast("int"))
    built = models.build_models(spec, {"logistic": {"regParam": [0.0, 0.5], "elasticNetParam": [0.0, 1.0]}})
    pipeline, grid = built["logistic"]
    auc = models.BinaryClassificationEvaluator(labelCol=spec.label, numBins=0)
    theirs = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=auc, numFolds=2, foldCol="fold").fit(folded)
    scaled, fit = [], StandardScaler._fit
    monkeypatch.setattr(StandardScaler, "_fit", lambda self, df: scaled.append(1) or fit(self, df))
    ours = models.cross_validate(folded, built, spec, 2, "fold")["logistic"]
    assert ours.avgMetrics == pytest.approx(theirs.avgMetrics, abs=1e-9) and len(scaled) == 3
    assert ours.bestModel.stages[-1].coefficients.toArray() == pytest.approx(theirs.bestModel.stages[-1].coefficients.toArray())
    assert len(ours.getEstimatorParamMaps()) == 4
