"""Registered queries on pair tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from termbridge.catalog.base import (
    PAIRS_SQL,
    RANKED_SQL,
    RAW_SQL,
    SPEC,
    bins_sql,
    cleaned,
    describe_sql,
    long_sql,
    raw_pairs,
    rounded,
    scored,
    settled,
    table,
)
from termbridge.operators import metrics, models, pairs, profile, ranking
from termbridge.session import cut_lineage

Q, S, D, L = SPEC.query, "score", SPEC.doc, SPEC.label
THRESHOLD = 0.5


def _labelled(spark, sf_dir):
    return pairs.threshold_label(scored(spark, sf_dir), S, THRESHOLD)


def _decisions(spark, sf_dir):
    return ranking.decide(scored(spark, sf_dir), Q, S, D, THRESHOLD)


def _folded(spark, sf_dir):
    return pairs.group_fold(cleaned(spark, sf_dir), Q, key=F.col(Q))


def group_fold(spark, sf_dir):
    return _folded(spark, sf_dir).select(Q, D, "fold")


def equal_weight_score(spark, sf_dir):
    weights = {"f_quantity": 2.0, "f_price": 0.5}
    both = pairs.equal_weight_score(
        scored(spark, sf_dir), SPEC.features, weights, how="sum", name="weighted_sum"
    )
    return both.select(Q, D, F.col(S).alias("mean_score"), "weighted_sum")


def synthetic_pairs(spark, sf_dir):
    return pairs.synthetic_pairs(table(spark, sf_dir, "customer"), "c_custkey")


def class_weights(spark, sf_dir):
    weighted = models.class_weights(settled(spark, sf_dir), L)
    return weighted.select(Q, D, L, "weight")


def downsample_negatives(spark, sf_dir):
    return models.downsample_negatives(settled(spark, sf_dir), L, [Q, D], 1.0).select(Q, D, L)


def most_uncertain(spark, sf_dir):
    found = models.most_uncertain(scored(spark, sf_dir), [Q, D], 50)
    return found.select(Q, D, S, L)


def ranked_lists(spark, sf_dir):
    lists = ranking.ranked_lists(settled(spark, sf_dir), Q, S, D, L)
    return lists.select(
        Q, "part", F.array_join("docs", ",").alias("docs"), F.array_join("truth", ",").alias("truth")
    )


QUERIES = {
    "clean_pairs": cleaned,
    "group_fold": group_fold,
    "split_summary": lambda s, d: rounded(pairs.split_summary(_folded(s, d), SPEC)),
    "equal_weight_score": equal_weight_score,
    "threshold_label": lambda s, d: _labelled(s, d).select(Q, D, "pred"),
    "label_sanity": lambda s, d: pairs.label_sanity(cleaned(s, d), SPEC),
    "synthetic_pairs": synthetic_pairs,
    "dataset_summary": lambda s, d: rounded(profile.dataset_summary(cleaned(s, d), SPEC)),
    "feature_describe": lambda s, d: rounded(profile.feature_describe(settled(s, d), SPEC.features)),
    "candidates_per_query": lambda s, d: rounded(profile.candidates_per_query(raw_pairs(s, d), Q)),
    "group_size_histogram": lambda s, d: rounded(profile.group_size_histogram(raw_pairs(s, d), Q)),
    "class_conditional_histogram": lambda s, d: rounded(
        profile.class_conditional_histogram(settled(s, d), SPEC.features, L)
    ),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(_labelled(s, d), L, "pred"),
    "classification_metrics": lambda s, d: rounded(
        metrics.classification_metrics(_labelled(s, d), L, "pred")
    ),
    "weighted_f1": lambda s, d: rounded(metrics.weighted_f1(_labelled(s, d), L, "pred")),
    "roc_auc": lambda s, d: rounded(metrics.roc_auc(scored(s, d), L, S)),
    "threshold_sweep": lambda s, d: rounded(metrics.threshold_sweep(scored(s, d), L, S)),
    "best_threshold": lambda s, d: rounded(
        metrics.best_threshold(metrics.threshold_sweep(scored(s, d), L, S))
    ),
    "coverage": lambda s, d: rounded(metrics.coverage(_decisions(s, d), L)),
    "error_summary": lambda s, d: rounded(profile.error_summary(_decisions(s, d), L)),
    "worst_errors": lambda s, d: profile.worst_errors(_decisions(s, d), L, S, Q, 20).select(Q, D, S),
    "error_analysis": lambda s, d: rounded(
        profile.error_analysis(cut_lineage(_decisions(s, d)), L, SPEC.features)
    ),
    "rank_candidates": lambda s, d: ranking.rank_candidates(settled(s, d), Q, S, D).select(Q, D, "rank"),
    "best_per_query": lambda s, d: ranking.best_per_query(scored(s, d), Q, S, D).select(Q, D, S, L),
    "top1_accuracy": lambda s, d: rounded(ranking.top1_accuracy(scored(s, d), Q, S, D, L)),
    "mean_average_precision": lambda s, d: rounded(
        ranking.mean_average_precision(settled(s, d), Q, S, D, L)
    ),
    "mean_reciprocal_rank": lambda s, d: rounded(
        ranking.mean_reciprocal_rank(settled(s, d), Q, S, D, L)
    ),
    "precision_at_k": lambda s, d: rounded(ranking.precision_at_k(scored(s, d), Q, S, D, L, 3)),
    "precision_at_fixed_k": lambda s, d: rounded(
        ranking.precision_at_k(scored(s, d), Q, S, D, L, 3, divide_by_k=True)
    ),
    "ranked_lists": ranked_lists,
    "ranking_report": lambda s, d: rounded(ranking.ranking_report(settled(s, d), Q, S, D, L)),
    "decide": lambda s, d: _decisions(s, d).select(Q, D, S, L, "accept"),
    "top_rows": lambda s, d: ranking.top_rows(
        scored(s, d), [F.col(S).desc(), F.col(Q), F.col(D)], 100
    ).select(Q, D, S),
    "class_weights": class_weights,
    "downsample_negatives": downsample_negatives,
    "most_uncertain": most_uncertain,
}

CELLS = """
cells AS (
  SELECT count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
         count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp
  FROM (SELECT *, CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS pred FROM scored))"""

SWEEP = """
grid AS (SELECT (10 + 2 * i) / 100.0::DOUBLE AS threshold FROM (SELECT unnest(range(43)) AS i)),
counted AS (
  SELECT threshold, sum(CASE WHEN score >= threshold THEN label ELSE 0 END)::DOUBLE AS tp,
         sum(CASE WHEN score >= threshold THEN 1 - label ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN score >= threshold THEN 0 ELSE label END)::DOUBLE AS fn,
         sum(CASE WHEN score >= threshold THEN 0 ELSE 1 - label END)::DOUBLE AS tn
  FROM grid CROSS JOIN scored GROUP BY threshold),
sweep AS (
  SELECT threshold,
    CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0.0 ELSE coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END AS f1,
    (tp + tn) / (tp + tn + fp + fn) AS accuracy,
    CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0.0 ELSE coalesce(tp / nullif(tp + fp, 0), 0) END AS precision,
    CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0.0 ELSE coalesce(tp / nullif(tp + fn, 0), 0) END AS recall,
    (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn)
     + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / (tp + tn + fp + fn) AS weighted_f1
  FROM counted)"""

SWEEP_COLUMNS = """round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(weighted_f1, 6) AS weighted_f1"""


def _uniform(*parts: str) -> str:
    joined = " || ':' || ".join(["'7'", *parts])
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _synthetic_feature(name: str, share: float) -> str:
    base = f"CASE WHEN j = gold THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END * {share}::DOUBLE"
    draw = _uniform("k", "j::VARCHAR", f"'{name}'")
    return f"least(greatest({draw} * 0.3::DOUBLE + {base}, 0.0), 1.0) AS {name}"


_PAIR_COLUMNS = ", ".join(["query_id", "doc_id", *SPEC.features])

SQL = {
    "clean_pairs": f"WITH {PAIRS_SQL} SELECT {_PAIR_COLUMNS}, label FROM pairs",
    "group_fold": f"WITH {PAIRS_SQL} SELECT query_id, doc_id, (query_id % 5)::INTEGER AS fold FROM pairs",
    "split_summary": f"""WITH {PAIRS_SQL}
SELECT query_id % 5 = 4 AS is_test, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries,
       round(avg(label::DOUBLE), 6) AS positive_rate FROM pairs GROUP BY 1""",
    "equal_weight_score": f"""WITH {PAIRS_SQL}
SELECT query_id, doc_id, score AS mean_score,
       f_quantity * 2.0::DOUBLE + f_discount + f_tax + f_price * 0.5::DOUBLE AS weighted_sum
FROM scored""",
    "threshold_label": f"""WITH {PAIRS_SQL}
SELECT query_id, doc_id, CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS pred FROM scored""",
    "label_sanity": f"""WITH {PAIRS_SQL}
SELECT query_id, sum(label)::BIGINT AS n_positive FROM pairs GROUP BY 1 HAVING sum(label) <> 1""",
    "synthetic_pairs": f"""
WITH sized AS (
  SELECT c_custkey::VARCHAR AS k, (5 + floor({_uniform("c_custkey::VARCHAR", "'size'")} * 16))::INTEGER AS n
  FROM customer),
gold AS (SELECT k, n, floor({_uniform("k", "'gold'")} * n)::INTEGER AS gold FROM sized),
docs AS (SELECT k, gold, unnest(range(n)) AS j FROM gold)
SELECT '9_' || k AS icd9_code, 'phenotype_' || k AS icd9_phe,
       '10_' || k || '_' || lpad(j::VARCHAR, 2, '0') AS icd10_code,
       'phenotype_' || CASE WHEN j = gold THEN k ELSE k || 'x' || j END AS icd10_phe,
       {_synthetic_feature("cosine_tfidf_word", 1.0)}, {_synthetic_feature("jaccard_tokens", 0.8)},
       {_synthetic_feature("dice_tokens", 0.85)}, {_synthetic_feature("levenshtein_ratio", 0.9)},
       {_synthetic_feature("cos_similarity", 0.95)}, CASE WHEN j = gold THEN 1 ELSE 0 END AS correct
FROM docs""",
    "dataset_summary": f"""WITH {PAIRS_SQL}
SELECT count(*) AS n_pairs, count(DISTINCT query_id) AS n_queries, count(DISTINCT doc_id) AS n_docs,
       sum(label)::BIGINT AS n_positive, sum(1 - label)::BIGINT AS n_negative,
       round(avg(label::DOUBLE), 6) AS positive_share, round(avg(1.0::DOUBLE - label), 6) AS negative_share
FROM pairs""",
    "feature_describe": f"WITH {PAIRS_SQL}, long AS ({long_sql('pairs')}) {describe_sql('long', 'feature')}",
    "candidates_per_query": f"""WITH {RAW_SQL}, sizes AS (SELECT query_id, count(*) AS size FROM raw GROUP BY 1)
SELECT round(avg(size), 6) AS mean, round(median(size), 6) AS median, min(size) AS min, max(size) AS max
FROM sizes""",
    "group_size_histogram": f"""WITH {RAW_SQL},
sizes AS (SELECT size AS value, count(*) AS n
          FROM (SELECT query_id, count(*) AS size FROM raw GROUP BY 1) GROUP BY 1),
{bins_sql("sizes", "")}
SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n FROM filled""",
    "class_conditional_histogram": f"""WITH {PAIRS_SQL},
long AS (SELECT label, feature, value, count(*) AS n FROM ({long_sql("pairs", "label, ")}) GROUP BY ALL),
{bins_sql("long", "feature, label")},
totals AS (SELECT feature, label, sum(n) AS total FROM long GROUP BY 1, 2)
SELECT feature, label, bin, round(low, 6) AS low, round(high, 6) AS high, n,
       round(n / (total * (high - low)), 6) AS density
FROM filled JOIN totals USING (feature, label)""",
    "confusion_matrix": f"WITH {PAIRS_SQL}, {CELLS} SELECT tn, fp, fn, tp FROM cells",
    "classification_metrics": f"""WITH {PAIRS_SQL}, {CELLS}
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
       round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(tp / (tp + fn)::DOUBLE, 6) AS sensitivity,
       round(tn / (tn + fp)::DOUBLE, 6) AS specificity, round(tp / (tp + fp)::DOUBLE, 6) AS ppv,
       round(tn / (tn + fn)::DOUBLE, 6) AS npv FROM cells""",
    "weighted_f1": f"""WITH {PAIRS_SQL}, {CELLS}
SELECT round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
       round((2 * tp / (2 * tp + fp + fn)::DOUBLE * (tp + fn)
              + 2 * tn / (2 * tn + fp + fn)::DOUBLE * (tn + fp)) / (tp + tn + fp + fn), 6) AS weighted_f1
FROM cells""",
    "roc_auc": f"""WITH {PAIRS_SQL},
s AS (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scored GROUP BY score),
a AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM s)
SELECT round(sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM a""",
    "threshold_sweep": f"WITH {PAIRS_SQL}, {SWEEP} SELECT {SWEEP_COLUMNS} FROM sweep",
    "best_threshold": f"""WITH {PAIRS_SQL}, {SWEEP}
SELECT {SWEEP_COLUMNS} FROM (SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)""",
    "coverage": f"""WITH {RANKED_SQL}
SELECT count(*) AS n_queries, sum(accept)::BIGINT AS n_accepted, sum(1 - accept)::BIGINT AS n_rejected,
       round(avg(accept::DOUBLE), 6) AS coverage,
       round(coalesce(avg(CASE WHEN accept = 1 THEN label::DOUBLE END), 0.0), 6) AS accuracy_on_accepted
FROM decisions""",
    "error_summary": f"""WITH {RANKED_SQL}
SELECT count(*) AS n_accepted, sum(1 - label)::BIGINT AS n_errors, round(avg(1.0::DOUBLE - label), 6) AS error_rate
FROM decisions WHERE accept = 1""",
    "worst_errors": f"""WITH {RANKED_SQL}
SELECT query_id, doc_id, score FROM (
  SELECT * FROM decisions WHERE accept = 1 AND label <> 1 ORDER BY score DESC, query_id LIMIT 20)""",
    "error_analysis": f"""WITH {RANKED_SQL},
accepted AS (SELECT *, 1 - label AS is_error FROM decisions WHERE accept = 1),
long AS ({long_sql("accepted", "is_error, ")}) {describe_sql("long", "is_error, feature")}""",
    "rank_candidates": f"WITH {RANKED_SQL} SELECT query_id, doc_id, rank FROM ranked",
    "best_per_query": f"""WITH {RANKED_SQL}
SELECT query_id, doc_id, score, label FROM ranked WHERE rank = 1""",
    "top1_accuracy": f"WITH {RANKED_SQL} SELECT round(avg(top1), 6) AS top1_accuracy FROM measures",
    "mean_average_precision": f"""WITH {RANKED_SQL}
SELECT round(avg(ap), 6) AS mean_average_precision FROM measures""",
    "mean_reciprocal_rank": f"""WITH {RANKED_SQL}
SELECT round(avg(rr), 6) AS mean_reciprocal_rank FROM measures""",
    "precision_at_k": f"""WITH {RANKED_SQL}
SELECT round(avg(p), 6) AS precision_at_k
FROM (SELECT avg(label::DOUBLE) AS p FROM ranked WHERE rank <= 3 GROUP BY query_id)""",
    "precision_at_fixed_k": f"""WITH {RANKED_SQL}
SELECT round(avg(p), 6) AS precision_at_k
FROM (SELECT sum(label) / 3.0::DOUBLE AS p FROM ranked WHERE rank <= 3 GROUP BY query_id)""",
    "ranked_lists": f"""WITH {RANKED_SQL}
SELECT query_id, 0 AS part, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS docs,
       coalesce(string_agg(CASE WHEN label = 1 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id), '') AS truth
FROM ranked GROUP BY query_id""",
    "ranking_report": f"""WITH {RANKED_SQL}
SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(top1), 6) AS p_at_k,
       round(avg(top1), 6) AS top1_accuracy FROM measures""",
    "decide": f"""WITH {RANKED_SQL}
SELECT query_id, doc_id, score, label, accept FROM decisions""",
    "top_rows": f"""WITH {PAIRS_SQL}
SELECT query_id, doc_id, score
FROM (SELECT * FROM scored ORDER BY score DESC, query_id, doc_id LIMIT 100)""",
    "class_weights": f"""WITH {PAIRS_SQL}
SELECT query_id, doc_id, label,
       count(*) OVER ()::DOUBLE / (2.0::DOUBLE * count(*) OVER (PARTITION BY label)) AS weight
FROM pairs""",
    "downsample_negatives": f"""WITH {PAIRS_SQL},
sizes AS (SELECT sum(label)::DOUBLE / sum(1 - label) AS share FROM pairs)
SELECT query_id, doc_id, label FROM pairs, sizes
WHERE label = 1 OR ('0x' || substr(md5(query_id || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < share""",
    "most_uncertain": f"""WITH {PAIRS_SQL}
SELECT query_id, doc_id, score, label FROM (
  SELECT * FROM scored ORDER BY abs(score - 0.5::DOUBLE), query_id, doc_id LIMIT 50)""",
}
