"""Registered queries on files, run comparison and models, with SQL where it can say them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from termbridge.catalog import pair_queries, resolve_queries
from termbridge.catalog.base import PAIRS_SQL, RANKED_SQL, SPEC, cleaned, rounded, scored, table
from termbridge.catalog.resolve_queries import CUSTOMERS, RESOLVE
from termbridge.catalog.vector_queries import SIZE, text_universe
from termbridge.operators import compare, models, pairs, ranking
from termbridge.operators.skew import first_rows
from termbridge.plans.evaluation import evaluate_pairs
from termbridge.session import cut_lineage, scratch_path
from termbridge.sources import readers, writers

col = F.col


# Files: tables are written to the shared folder in the input format and read back.


def _write(df, name, sep=","):
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def read_universe_csv(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    synonyms = F.concat_ws("| ", "p_brand", F.lit(" "), "p_type")
    path = _write(
        part.select(
            F.concat(F.lit(" "), F.lpad(col("p_partkey").cast("string"), 8, "0")).alias("code"),
            F.concat(col("p_name"), F.lit(', "new" ')).alias("name"),
            F.when(col("p_size") > 10, synonyms).alias("synonyms"),
            F.when(col("p_size") > 25, col("p_type")).alias("description"),
        ),
        "universe",
    )
    read = readers.read_universe_csv(spark, path)
    return read.withColumn("synonyms", F.array_join("synonyms", "|"))


def read_universe_tsv(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = _write(
        part.select(col("p_name").alias("icd10_phe"), col("p_partkey").alias("icd10_code")),
        "universe_tsv",
        "\t",
    )
    return readers.read_universe_tsv(spark, path).select("code", "name", "n_rows")


def _records(df):
    rows = df.select("code", "name", F.posexplode_outer("direct_candidates").alias("pos", "c"))
    return rows.select("code", "name", "pos", col("c.code").alias("direct"), col("c.name").alias("given"))


def read_records_csv(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cell = F.concat(col("p_brand"), F.lit(":"), col("p_name"), F.lit("| "), col("p_type"))
    path = _write(
        part.select(
            F.lpad(col("p_partkey").cast("string"), 6, "0").alias("icd9_code"),
            col("p_name").alias("icd9_name"),
            F.when(col("p_size") > 10, cell).alias("direct"),
        ),
        "records",
    )
    return _records(readers.read_records_csv(spark, path))


def read_records_tsv(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cell = F.concat(
        F.lit("ICD10_code:"), col("p_brand"), F.lit(":phenoname:"), col("p_name"),
        F.lit(" | ICD10_code:"), col("p_type"),
    )
    path = _write(
        part.select(
            F.lpad(col("p_partkey").cast("string"), 6, "0").alias("icd9_code"),
            col("p_name").alias("icd9_phe"),
            F.when(col("p_size") > 10, cell).alias("potential_matches"),
        ),
        "records_tsv",
        "\t",
    )
    return _records(readers.read_records_tsv(spark, path))


def read_pairs(spark, sf_dir):
    """The pair table through CSV."""
    path = scratch_path(spark, "pairs") + ".csv"
    made = cleaned(spark, sf_dir)
    made.write.option("header", True).csv(path)
    return readers.read_pairs(spark, path, made.schema)


def _results(spark, sf_dir):
    return resolve_queries.results(spark, sf_dir)


def write_results_jsonl(spark, sf_dir):
    path = scratch_path(spark, "results")
    writers.write_results_jsonl(_results(spark, sf_dir), path)
    read = readers.read_results_jsonl(spark, path)
    return read.select(
        "input.icd9_code",
        F.size("input.direct_candidates").alias("n_direct"),
        F.size("allowed_candidates").alias("n_allowed"),
        "selected_code",
        "retrieved_top_k",
        "num_attempts",
        "is_multi_map",
    )


def write_results_csv(spark, sf_dir):
    path = scratch_path(spark, "flat")
    writers.write_results_csv(_results(spark, sf_dir), path, "tsv")
    return readers.read_result_csv(spark, path)


def write_audit_jsonl(spark, sf_dir):
    path = scratch_path(spark, "audit")
    whole = resolve_queries.mapped(spark, sf_dir, audit=True)
    writers.write_audit_jsonl(whole, path)
    read = spark.read.schema(
        "input struct<icd9_code:string>, audit struct<attempts:array<struct<attempt_index:int,note:string>>>"
    ).json(path)
    return read.select(
        col("input.icd9_code").cast("long").alias("record_id"),
        F.size("audit.attempts").alias("n_entries"),
    )


def save_index(spark, sf_dir):
    """The embedded documents, written, found complete and loaded."""
    folder = scratch_path(spark, "index")
    config = writers.IndexConfig(size=SIZE)

    def build():
        return text_universe(spark, sf_dir)[1]

    writers.build_if_missing(spark, folder, build, config)
    universe, found = writers.build_if_missing(spark, folder, build, config)
    return universe.select(
        "code",
        F.length("name").alias("name_length"),
        F.size("embedding").alias("size"),
        F.lit(found.normalized).alias("normalized"),
    )


def write_eval_outputs(spark, sf_dir):
    """Scores of all pairs and one decision per query through the output folder."""
    folder = scratch_path(spark, "evaluation")
    predictions = cut_lineage(scored(spark, sf_dir))
    decisions = ranking.decide(predictions, SPEC.query, "score", SPEC.doc, 0.5)
    report = ranking.ranking_report(predictions, SPEC.query, "score", SPEC.doc, SPEC.label)
    writers.write_eval_outputs(report, decisions, predictions, folder)
    read = spark.read.csv(
        f"{folder}/best_decisions", header=True, schema=decisions.schema, enforceSchema=True
    )
    return read.select(SPEC.query, SPEC.doc, SPEC.label, "accept")


# Two runs: the first and the last order of every customer.


def _run(spark, sf_dir, newest):
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"
    )
    key = col("o_orderkey")
    one = first_rows(orders, ["o_custkey"], [key.desc() if newest else key.asc()])
    confidence = (
        F.when(col("o_orderstatus") == "F", "strong")
        .when(col("o_orderstatus") == "O", "medium")
        .otherwise("unsure")
    )
    code = F.when(col("o_orderpriority") != "5-LOW", col("o_orderpriority"))
    return one.select(
        F.concat(F.lit(" "), col("o_custkey").cast("string")).alias("icd9_code"),
        F.concat(F.lit("customer "), col("o_custkey").cast("string")).alias("icd9_name"),
        code.alias("selected_code"),
        col("o_orderpriority").alias("selected_name"),
        confidence.alias("confidence"),
    )


def _joined(spark, sf_dir):
    return compare.compare_join(_run(spark, sf_dir, False), _run(spark, sf_dir, True))


# Models


def _train(spark, sf_dir):
    return cut_lineage(pairs.group_fold(cleaned(spark, sf_dir), SPEC.query, 4))


def _fitted(spark, sf_dir, name, rows=None):
    """A model of fixed settings trained on all but one fold, and that fold scored."""
    train, test = pairs.train_test(_train(spark, sf_dir) if rows is None else rows, 3)
    settings = {"logistic": {}, "random_forest": {"numTrees": [200], "maxDepth": [10]}, "gbt": {}}
    pipeline, grid = models.build_models(SPEC, {name: settings[name]})[name]
    model = pipeline.fit(train, grid[0])
    return model, models.score_pairs(model, test)


def _report(name):
    def query(spark, sf_dir):
        return rounded(models.evaluate(_fitted(spark, sf_dir, name)[1], SPEC, name))

    return query


def assemble_scale(spark, sf_dir):
    """Every pair's standardised features."""
    clean = cut_lineage(cleaned(spark, sf_dir))
    applied = Pipeline(stages=models.assemble_scale(SPEC)).fit(clean).transform(clean)
    values = vector_to_array("features")
    return rounded(
        applied.select(
            SPEC.query, SPEC.doc, *[values[i].alias(f"z{i}") for i in range(len(SPEC.features))]
        )
    )


def cross_validate(spark, sf_dir):
    """Mean AUC of logistic settings over folds that keep queries whole."""
    train = _train(spark, sf_dir)
    grid = {"logistic": {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0]}}
    fitted = models.cross_validate(train, models.build_models(SPEC, grid), SPEC, 4, "fold")
    return rounded(models.cross_validation_table(spark, fitted))


def score_pairs(spark, sf_dir):
    return rounded(_fitted(spark, sf_dir, "logistic")[1].select(SPEC.query, SPEC.doc, "score"))


def feature_importance(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir, "random_forest")
    return rounded(models.feature_importance(spark, model, SPEC))


def model_comparison(spark, sf_dir):
    """The baseline and all models on the same test rows."""
    made = _train(spark, sf_dir)
    _, test = pairs.train_test(made, 3)
    rows = [models.evaluate(pairs.equal_weight_score(test, SPEC.features), SPEC, "baseline")]
    rows += [models.evaluate(_fitted(spark, sf_dir, m, made)[1], SPEC, m) for m in ("logistic", "random_forest", "gbt")]
    return models.model_comparison(rows)


def isotonic_calibration(spark, sf_dir):
    """Calibrated score of every pair, from the scores as they are."""
    rows = cut_lineage(scored(spark, sf_dir))
    fitted = models.fit_isotonic(rows, SPEC.label)
    return rounded(fitted.transform(rows).select(SPEC.query, SPEC.doc, "calibrated"))


def evaluate(spark, sf_dir):
    """All measures of the equal-weight score."""
    return rounded(models.evaluate(scored(spark, sf_dir), SPEC, "baseline"))


def read_result_csv(spark, sf_dir):
    """A flat result of two runs' columns, one of them under an older category name."""
    orders = table(spark, sf_dir, "orders")
    older = F.when(col("o_orderstatus") == "F", "CLOSE_MATCH").otherwise("OTHER_MATCH")
    path = _write(
        orders.select(
            F.concat(F.lit("  00"), col("o_orderkey").cast("string"), F.lit(" ")).alias("icd9_code"),
            older.alias("mapping_category"),
        ),
        "old_results",
    )
    return readers.read_result_csv(spark, path)


def evaluate_all(spark, sf_dir):
    """The whole evaluation with one logistic setting: coverage of its decisions."""
    run = evaluate_pairs(cleaned(spark, sf_dir), SPEC, {"logistic": {}}, folds=2)
    return rounded(run.coverage)


QUERIES = {
    "read_universe_csv": read_universe_csv,
    "read_universe_tsv": read_universe_tsv,
    "read_records_csv": read_records_csv,
    "read_records_tsv": read_records_tsv,
    "read_pairs": read_pairs,
    "write_results_jsonl": write_results_jsonl,
    "write_results_csv": write_results_csv,
    "write_audit_jsonl": write_audit_jsonl,
    "read_result_csv": read_result_csv,
    "write_eval_outputs": write_eval_outputs,
    "save_index": save_index,
    "compare_join": _joined,
    "compare_diff": lambda s, d: compare.compare_diff(_joined(s, d)),
    "compare_summary": lambda s, d: rounded(compare.compare_summary(_joined(s, d))),
    "confidence_distribution": lambda s, d: compare.confidence_distribution(_joined(s, d)),
    "case_check": lambda s, d: compare.case_check(_joined(s, d), "7", "2-HIGH"),
    "assemble_scale": assemble_scale,
    "evaluate": evaluate,
    "logistic": _report("logistic"),
    "random_forest": _report("random_forest"),
    "gbt": _report("gbt"),
    "cross_validate": cross_validate,
    "score_pairs": score_pairs,
    "feature_importance": feature_importance,
    "model_comparison": model_comparison,
    "isotonic_calibration": isotonic_calibration,
    "evaluate_pairs": evaluate_all,
}

_RUN = """
SELECT o_custkey::VARCHAR AS icd9_code, 'customer ' || o_custkey AS icd9_name,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS selected_code,
       o_orderpriority AS selected_name,
       CASE o_orderstatus WHEN 'F' THEN 'strong' WHEN 'O' THEN 'medium' ELSE 'unsure' END AS confidence
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {}) = 1"""

JOINED = f"""
joined AS (
  SELECT icd9_code, a.icd9_name AS icd9_name_baseline, a.selected_code AS selected_code_baseline,
         a.selected_name AS selected_name_baseline, a.confidence AS confidence_baseline,
         b.icd9_name AS icd9_name_synonym, b.selected_code AS selected_code_synonym,
         b.selected_name AS selected_name_synonym, b.confidence AS confidence_synonym, 1::BIGINT AS n_pairs
  FROM ({_RUN.format("ASC")}) a JOIN ({_RUN.format("DESC")}) b USING (icd9_code)),
levels AS (SELECT * FROM (VALUES ('strong', 3), ('medium', 2), ('weak', 1)) AS t (level, n)),
changed AS (
  SELECT joined.*, coalesce(y.n, 0) - coalesce(x.n, 0) AS rose,
         selected_code_baseline IS DISTINCT FROM selected_code_synonym AS differs
  FROM joined LEFT JOIN levels x ON x.level = confidence_baseline LEFT JOIN levels y ON y.level = confidence_synonym)"""

_RECORDS_SQL = """
SELECT lpad(p_partkey::VARCHAR, 6, '0') AS code, p_name AS name, 0 AS pos, p_brand AS direct, p_name AS given
FROM part WHERE p_size > 10
UNION ALL SELECT lpad(p_partkey::VARCHAR, 6, '0'), p_name, 1, p_type, NULL FROM part WHERE p_size > 10
UNION ALL SELECT lpad(p_partkey::VARCHAR, 6, '0'), p_name, NULL, NULL, NULL FROM part WHERE p_size <= 10"""

_Z = ", ".join(
    f"round(({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER (), 6) + 0.0::DOUBLE AS z{i}"
    for i, f in enumerate(SPEC.features)
)

SQL = {
    "read_universe_csv": """
SELECT lpad(p_partkey::VARCHAR, 8, '0') AS code, p_name || ', "new"' AS name,
       CASE WHEN p_size > 10 THEN p_brand || '|' || p_type ELSE '' END AS synonyms,
       CASE WHEN p_size > 25 THEN p_type END AS description, 1::BIGINT AS n_rows FROM part""",
    "read_universe_tsv": "SELECT p_partkey::VARCHAR AS code, p_name AS name, 1::BIGINT AS n_rows FROM part",
    "read_records_csv": _RECORDS_SQL,
    "read_records_tsv": _RECORDS_SQL,
    "read_pairs": f"WITH {PAIRS_SQL} SELECT * FROM pairs",
    "write_results_jsonl": f"""WITH {CUSTOMERS}, {RESOLVE},
lists AS (SELECT record_id, count(*)::INTEGER AS n_allowed FROM candidates GROUP BY 1),
sizes AS (SELECT record_id, count(*)::INTEGER AS retrieved_top_k FROM retrieved GROUP BY 1),
directs AS (SELECT record_id, count(*)::INTEGER AS n FROM direct GROUP BY 1)
SELECT r.code AS icd9_code, coalesce(n, 0) AS n_direct, coalesce(n_allowed, 0) AS n_allowed, selected_code,
       coalesce(retrieved_top_k, 0) AS retrieved_top_k, num_attempts, is_multi_map
FROM records r JOIN selections USING (record_id) LEFT JOIN lists USING (record_id) LEFT JOIN sizes USING (record_id)
LEFT JOIN directs USING (record_id)""",
    "write_results_csv": f"""WITH {CUSTOMERS}, {RESOLVE}
SELECT r.code AS icd9_code, r.name AS icd9_name, selected_code, selected_name, confidence, rationale, mapping_category,
       match_specificity, external_choice_reason, is_multi_map::VARCHAR AS is_multi_map, more_broad_icd10_code,
       more_broad_icd10_name, closest_exact_icd10_code, closest_exact_icd10_name, num_attempts::VARCHAR AS num_attempts,
       attempted_returned_code, attempted_returned_name, salvage_strategy
FROM records r JOIN selections USING (record_id)""",
    "write_audit_jsonl": resolve_queries.SQL["map_records_audited"],
    "write_eval_outputs": f"""WITH {PAIRS_SQL}
SELECT query_id, doc_id, label, CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS accept
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1""",
    "save_index": """
SELECT doc_id::VARCHAR AS code, length(text)::INTEGER AS name_length, 256 AS size, true AS normalized FROM documents""",
    "compare_join": f"WITH {JOINED} SELECT * FROM joined",
    "compare_diff": f"""WITH {JOINED}
SELECT * EXCLUDE (rose, differs),
       CASE WHEN rose > 0 THEN 'improvement' WHEN rose < 0 THEN 'regression' ELSE 'same' END AS change
FROM changed WHERE differs""",
    "compare_summary": f"""WITH {JOINED}
SELECT count(*) AS n_joined, count(*) FILTER (differs) AS n_different, count(*) FILTER (differs AND rose > 0) AS n_improvement,
       count(*) FILTER (differs AND rose < 0) AS n_regression, count(*) FILTER (differs AND rose = 0) AS n_same_confidence,
       round(100.0::DOUBLE * count(*) FILTER (differs) / nullif(count(*), 0), 6) AS percent_different FROM changed""",
    "confidence_distribution": f"""WITH {JOINED}
SELECT 'baseline' AS run, confidence_baseline AS confidence, count(*) AS n FROM joined GROUP BY 2
UNION ALL SELECT 'synonym', confidence_synonym, count(*) FROM joined GROUP BY 2""",
    "case_check": f"""WITH {JOINED}
SELECT '7' AS icd9_code, '2-HIGH' AS expected, CASE coalesce(min(
         CASE WHEN selected_code_synonym = '2-HIGH' THEN 1 WHEN selected_code_baseline = '2-HIGH' THEN 2 ELSE 3 END), 0)
       WHEN 1 THEN 'found_by_second' WHEN 2 THEN 'already_in_first' WHEN 3 THEN 'neither' ELSE 'not_in_set' END AS outcome
FROM joined WHERE icd9_code = '7'""",
    "assemble_scale": f"WITH {PAIRS_SQL} SELECT query_id, doc_id, {_Z} FROM pairs",
    "read_result_csv": """
SELECT '00' || o_orderkey AS icd9_code,
       CASE WHEN o_orderstatus = 'F' THEN 'DIRECT_MATCH' ELSE 'OTHER_MATCH' END AS mapping_category FROM orders""",
    "evaluate": f"""WITH {RANKED_SQL}, {pair_queries.CELLS},
by_score AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scored GROUP BY score),
above AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM by_score),
auc AS (SELECT sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM above),
means AS (SELECT avg(ap) AS map, avg(rr) AS mrr, avg(top1) AS p_at_k, avg(top1) AS top1_accuracy FROM measures)
SELECT 'baseline' AS model, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
       round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(tp / (tp + fn)::DOUBLE, 6) AS sensitivity,
       round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(tp / (tp + fp)::DOUBLE, 6) AS ppv,
       round(tn / (tn + fn)::DOUBLE, 6) AS npv, round(auc, 6) AS auc, round(map, 6) AS map, round(mrr, 6) AS mrr,
       round(p_at_k, 6) AS p_at_k, round(top1_accuracy, 6) AS top1_accuracy
FROM cells, auc, means""",
    # The fitted value of a point: over all starts at or below it, the largest of the least
    # means of the runs from there that reach it.
    # Rounds of pooling all neighbours whose shares do not rise, until they do.
    "isotonic_calibration": f"""WITH RECURSIVE {PAIRS_SQL},
points AS (SELECT score AS lo, score AS hi, sum(label)::BIGINT AS p, count(*)::BIGINT AS n FROM scored GROUP BY score),
pool(turn, lo, hi, p, n) AS (
  SELECT 0, lo, hi, p, n FROM points
  UNION ALL
  SELECT turn + 1, min(lo), max(hi), sum(p)::BIGINT, sum(n)::BIGINT
  FROM (SELECT *, sum(rises) OVER (ORDER BY lo) AS g, min(rises) OVER () AS least
        FROM (SELECT *, CASE WHEN lag(p) OVER w * n >= p * lag(n) OVER w THEN 0 ELSE 1 END AS rises FROM pool WINDOW w AS (ORDER BY lo)))
  WHERE least = 0 GROUP BY turn, g),
fitted AS (SELECT lo, hi, p::DOUBLE / n AS value FROM pool WHERE turn = (SELECT max(turn) FROM pool))
SELECT query_id, doc_id, round(value, 6) AS calibrated FROM scored JOIN fitted ON score BETWEEN lo AND hi""",
}
