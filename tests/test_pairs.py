import math

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from termbridge.operators import metrics, models, pairs, profile, ranking, skew
from termbridge.schemas import PairSpec

SPEC = PairSpec("q", "d", "y", None, None, ["f", "g"])


@pytest.fixture(scope="module")
def scored(spark):
    """400 queries of 1 to 9 candidates with many ties, and one query with a third of the rows."""
    rng = np.random.default_rng(5)
    rows = [
        (q, d, float(rng.integers(0, 6)) / 5, int(rng.random() < 0.3))
        for q in range(400)
        for d in range(int(rng.integers(1, 10)))
    ]
    rows += [(1000, d, float(rng.integers(0, 6)) / 5, int(rng.random() < 0.3)) for d in range(1000)]
    return spark.createDataFrame(rows, "q int, d int, s double, y int").repartition(5).cache()


def expected_ranks(df):
    pdf = df.toPandas().sort_values(["q", "s", "d"], ascending=[True, False, True])
    pdf["rank"] = pdf.groupby("q").cumcount() + 1
    return pdf


def test_clean_pairs(spark):
    df = spark.createDataFrame(
        [
            (1, 1, 0.5, 0.5, 1, 2),
            (1, 1, 0.4, 0.4, 0, 1),
            (1, 2, None, 0.1, 0, 1),
            (1, 3, math.nan, 0.1, 0, 1),
            (2, 1, 0.1, 0.2, None, 1),
            (2, 2, 0.1, 0.2, 0, 1),
        ],
        "q int, d int, f double, g double, y int, at int",
    )
    rows = {(r.q, r.d): (r.f, r.y) for r in pairs.clean_pairs(df, SPEC, [F.col("at")]).collect()}
    assert rows == {(1, 1): (0.4, 0), (2, 2): (0.1, 0)}


def test_folds_keep_queries_whole(scored):
    folds = pairs.group_fold(scored, "q")
    assert folds.groupBy("q").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    train, test = pairs.train_test(folds)
    assert train.count() + test.count() == scored.count()
    assert train.join(test, "q", "left_semi").isEmpty()


def test_synthetic_pairs_do_not_depend_on_partitions(spark):
    queries = spark.range(50).withColumnRenamed("id", "k")
    made = [
        sorted(map(tuple, pairs.synthetic_pairs(queries.repartition(n), "k").collect()))
        for n in (1, 4, 16)
    ]
    assert made[0] == made[1] == made[2]
    df = pairs.synthetic_pairs(queries, "k")
    sizes = df.groupBy("icd9_code").agg(F.count("*").alias("n"), F.sum("correct").alias("p")).collect()
    assert len(sizes) == 50 and all(5 <= r.n <= 20 and r.p == 1 for r in sizes)


@pytest.fixture(params=[1, 3, 40])
def slices(spark, request):
    """So many slices that a group lies in one, and that a group spans many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_in_slices(scored, slices):
    got = ranking.rank_candidates(scored, "q", "s", "d").toPandas()
    want = expected_ranks(scored)
    merged = want.merge(got, on=["q", "d"], suffixes=("", "_got"))
    assert len(merged) == len(want) and (merged["rank"] == merged["rank_got"]).all()


def test_ranking_measures(scored, slices):
    pdf = expected_ranks(scored)
    aps, rrs, p3, top = [], [], [], []
    for _, g in pdf.groupby("q"):
        y = g["y"].to_numpy()
        hits = np.flatnonzero(y) + 1
        aps.append(sum((i + 1) / r for i, r in enumerate(hits)) / max(len(hits), 1))
        rrs.append(1 / hits[0] if len(hits) else 0.0)
        p3.append(y[:3].mean())
        top.append(y[0])
    row = ranking.ranking_report(scored, "q", "s", "d", "y", 3).first()
    assert np.allclose(list(row), [np.mean(aps), np.mean(rrs), np.mean(p3), np.mean(top)])
    assert np.isclose(ranking.precision_at_k(scored, "q", "s", "d", "y", 3).first()[0], np.mean(p3))
    assert np.isclose(ranking.top1_accuracy(scored, "q", "s", "d", "y").first()[0], np.mean(top))


def test_reciprocal_ranks_one_two_one(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.9, 1), (1, 2, 0.1, 0), (2, 1, 0.9, 0), (2, 2, 0.1, 1), (3, 1, 0.5, 1)],
        "q int, d int, s double, y int",
    )
    assert round(ranking.mean_reciprocal_rank(df, "q", "s", "d", "y").first()[0], 4) == 0.8333
    short = ranking.precision_at_k(df.filter("q = 1"), "q", "s", "d", "y", 3)
    fixed = ranking.precision_at_k(df.filter("q = 1"), "q", "s", "d", "y", 3, divide_by_k=True)
    assert short.first()[0] == 0.5 and abs(fixed.first()[0] - 1 / 3) < 1e-12


def test_long_lists_go_on_in_parts(scored):
    lists = ranking.ranked_lists(scored, "q", "s", "d", "y", slice_rows=300)
    long = sorted(lists.filter("q = 1000").collect(), key=lambda r: r.part)
    assert [len(r.docs) for r in long] == [300, 300, 300, 100]
    want = expected_ranks(scored).query("q == 1000")
    assert [d for r in long for d in r.docs] == list(want["d"])
    assert {d for r in long for d in r.truth} == set(want.query("y == 1")["d"])


def test_binary_and_weighted_f1(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (0, 0)], "y int, pred int")
    row = metrics.classification_metrics(df, "y", "pred").first()
    assert round(row.f1, 4) == 0.6667 and row.recall == 1.0 and row.precision == 0.5
    weighted = metrics.weighted_f1(df, "y", "pred").first()
    assert round(weighted.weighted_f1, 4) == 0.7667
    evaluator = MulticlassClassificationEvaluator(labelCol="y", predictionCol="p", metricName="f1")
    assert np.isclose(evaluator.evaluate(df.withColumn("p", F.col("pred").cast("double"))), weighted.weighted_f1)


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    row = metrics.classification_metrics(df, "y", "pred").first()
    assert (row.precision, row.recall, row.f1, row.accuracy, row.npv) == (0.0, 0.0, 0.0, 1.0, 1.0)
    empty = metrics.classification_metrics(df.filter("y = 5"), "y", "pred").first()
    assert empty.accuracy == 0.0 and empty.tn == 0


def test_auc_by_pair_counting(spark):
    rng = np.random.default_rng(3)
    for n in (2, 7, 60):
        y = np.r_[0, 1, rng.integers(0, 2, n)]
        s = rng.integers(0, 5, n + 2) / 4
        pos, neg = s[y == 1], s[y == 0]
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
        assert np.isclose(metrics.roc_auc(df.repartition(3), "y", "s").first()[0], want)
    one_class = df.filter("y = 1")
    assert metrics.roc_auc(one_class, "y", "s").first()[0] is None


def test_threshold_sweep(scored):
    pdf = scored.toPandas()
    rows = metrics.threshold_sweep(scored, "y", "s").orderBy("threshold").collect()
    assert len(rows) == 43 and rows[0].threshold == 0.1 and rows[-1].threshold == 0.94
    for r in rows:
        pred = pdf["s"] >= r.threshold
        tp, fp = (pred & (pdf.y == 1)).sum(), (pred & (pdf.y == 0)).sum()
        fn = ((~pred) & (pdf.y == 1)).sum()
        assert np.isclose(r.f1, 2 * tp / (2 * tp + fp + fn))
        assert np.isclose(r.accuracy, (pred == (pdf.y == 1)).mean())
    assert metrics.threshold_sweep(scored, "y", "s", metrics.default_grid(last=90)).count() == 41
    best = metrics.best_threshold(metrics.threshold_sweep(scored, "y", "s")).first()
    top = max(r.f1 for r in rows)
    assert best.f1 == top and best.threshold == min(r.threshold for r in rows if r.f1 == top)


def test_sweep_single_class(spark):
    df = spark.createDataFrame([(0.99, 1), (0.98, 1)], "s double, y int")
    assert metrics.threshold_sweep(df, "y", "s").agg(F.max("f1")).first()[0] == 0.0
    plain = metrics.threshold_sweep(df, "y", "s", single_class_zero=False)
    assert plain.agg(F.min("f1")).first()[0] == 1.0


def test_coverage_without_accepted(scored):
    decisions = ranking.decide(scored, "q", "s", "d", 2.0)
    row = metrics.coverage(decisions, "y").first()
    assert row.n_queries == 401 and row.n_accepted == 0 and row.accuracy_on_accepted == 0.0
    assert metrics.coverage(decisions, "y", empty=None).first().accuracy_on_accepted is None


def test_describe(scored, slices):
    wide = scored.withColumn("t", F.col("s") * F.col("d"))
    got = profile.feature_describe(wide, ["s", "t"], ["y"]).collect()
    pdf = wide.toPandas()
    assert len(got) == 4
    for r in got:
        want = pdf[pdf.y == r.y][r.feature].describe()
        names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
        assert np.allclose([r[c] for c in ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]], want[names])


def test_histograms(scored):
    sizes = scored.groupBy("q").count().toPandas()["count"]
    counts, edges = np.histogram(sizes, bins=30)
    rows = profile.group_size_histogram(scored, "q").orderBy("bin").collect()
    assert [r.n for r in rows] == list(counts) and np.allclose([r.low for r in rows], edges[:-1])
    pdf = scored.toPandas()
    by_class = profile.class_conditional_histogram(scored, ["s"], "y")
    for y in (0, 1):
        want, _ = np.histogram(pdf[pdf.y == y].s, bins=30, density=True)
        got = by_class.filter(F.col("y") == y).orderBy("bin").collect()
        assert np.allclose([r.density for r in got], want)
    flat = scored.withColumn("s", F.lit(2.0))
    got = profile.class_conditional_histogram(flat, ["s"], "y").filter("n > 0").collect()
    assert {(r.bin, r.low <= 2.0 < r.high) for r in got} == {(15, True)}


def test_running_sums_in_slices(scored, slices):
    w = Window.partitionBy("q").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("y") == 1, F.col("d"))
    want = scored.withColumns({"c": F.sum(F.col("y").cast("long")).over(w), "t": F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")})
    got = skew.running_sums(scored, ["q"], [F.col("d").asc()], {"c": F.col("y"), "t": value})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert skew.running_sums(scored.where("false"), ["q"], [F.col("d")], {"c": F.col("y")}).collect() == []
    whole = skew.running_sums(scored, [], [F.col("q"), F.col("d")], {"n": F.lit(1)})
    assert sorted(r.n for r in whole.collect()) == list(range(1, scored.count() + 1))


def test_the_pairs_are_shuffled_once(spark, monkeypatch):
    pairs = spark.range(1000).selectExpr("id % 7 AS q", "id AS d", "id / 3 AS s")
    plans, cut = [], skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: plans.append(df) or cut(df))
    ranked = ranking.rank_candidates(pairs, "q", "s", "d")
    before = plans[0]._jdf.queryExecution().executedPlan().toString()
    after = ranked._jdf.queryExecution().executedPlan().toString()
    assert before.count("Exchange rangepartitioning") == 1 and before.count("Exchange") == 1
    assert "SortMergeJoin" not in after and after.count("BroadcastHashJoin") == 1


def test_first_rows_beyond_the_group_limit(scored, slices):
    order = [F.col("s").desc(), F.col("d").asc()]
    want = expected_ranks(scored)
    for n in (3, 1200):
        rows = skew.first_rows(scored, ["q"], order, n, "at").collect()
        kept = want[want["rank"] <= n]
        assert {(r.q, r.d, r["at"]) for r in rows} == set(zip(kept.q, kept.d, kept["rank"]))


def test_weights_and_sampling(scored):
    weighted = models.class_weights(scored, "y")
    sums = {r.y: r.w for r in weighted.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    assert np.isclose(sums[0], sums[1])
    kept = models.downsample_negatives(scored, "y", ["q", "d"], 1.0).groupBy("y").count()
    n = {r.y: r["count"] for r in kept.collect()}
    assert n[1] == scored.filter("y = 1").count() and abs(n[0] - n[1]) < 0.2 * n[1]


def test_isotonic_is_monotone(scored):
    fitted = models.fit_isotonic(scored, "y", "s")
    rows = fitted.transform(scored).select("s", "calibrated").distinct().orderBy("s").collect()
    values = [r.calibrated for r in rows]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1


def test_null_groups_stay(spark, slices):
    rows = spark.createDataFrame([(None, k) for k in range(50)] + [("a", k) for k in range(30)], "g string, k int")
    numbered = skew.running_sums(rows, ["g"], [F.col("k")], {"n": F.lit(1)})
    assert sorted(map(str, numbered.collect())) == sorted(str(Row(g=g, k=k, n=k + 1)) for g, m in ((None, 50), ("a", 30)) for k in range(m))


def test_isotonic_against_pooling_one_by_one(spark, slices):
    rng = np.random.default_rng(9)
    rows = [(float(s), int(rng.random() < s), int(k)) for k, s in enumerate(np.r_[rng.random(700), rng.integers(0, 5, 200) / 4])]
    frame = spark.createDataFrame(rows, "s double, y int, k int").repartition(4)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    points = np.unique(x)
    p, n = (np.array([f[x == v].sum() for v in points]) for f in (y, np.ones(len(x))))
    cp, cn = np.append(0, np.cumsum(p)), np.append(0, np.cumsum(n))
    mean = [[(cp[b + 1] - cp[a]) / (cn[b + 1] - cn[a]) if b >= a else np.inf for b in range(len(points))] for a in range(len(points))]
    least = np.minimum.accumulate(np.array(mean)[:, ::-1], axis=1)[:, ::-1]  # of runs from a that end at b or later
    want = {v: max(least[a][i] for a in range(i + 1)) for i, v in enumerate(points)}
    fitted = models.fit_isotonic(frame, "y", "s")
    got = fitted.transform(frame).collect()
    assert len(got) == len(rows) and all(abs(r.calibrated - want[r.s]) < 1e-12 for r in got)
    # Between points a straight line, beyond them the ends, nothing for a null.
    values = [want[v] for v in points]
    asked = [0.0, 1.0, None, *(float(v) for v in rng.random(50))]
    found = fitted.transform(spark.createDataFrame([(v,) for v in asked], "s double"), "c").collect()
    for r in found:
        assert r.c is None if r.s is None else abs(r.c - np.interp(r.s, points, values)) < 1e-12
    assert fitted.transform(frame.where("false")).count() == 0
    alone = models.fit_isotonic(frame.where("k = 0"), "y", "s").transform(frame.select("s")).select("calibrated").distinct().collect()
    assert [r[0] for r in alone] == [float(rows[0][1])]
